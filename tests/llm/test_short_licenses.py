"""One-line license templates: changed words are found, other licenses are not taken for them."""

from __future__ import annotations

import pytest

from folio.llm import licenses
from folio.llm.templates import TEMPLATES

INDEX, HASHES = licenses.Index(TEMPLATES), licenses.Hashes()
SHORT = [(name, licenses.words_of(t)) for name, texts in TEMPLATES.items() for t in texts if len(licenses.words_of(t)) < licenses.SHORT]


def found(text):
    return [m["license"] for m in licenses.scan(text, INDEX, HASHES)]


@pytest.mark.parametrize("name, words", SHORT)
def test_one_changed_word_is_found(name, words):
    tell = {w for p in licenses.phrases_of(name, words) for w in p}
    assert tell
    for k, w in enumerate(words):
        changed = [*"some words go before here".split(), *words[:k], "qqq", *words[k + 1:], *"and some come after it".split()]
        assert found(" ".join(changed)) == ([] if w in tell else [name]), changed


@pytest.mark.parametrize("text", [
    "This work is licensed under the GNU General Public License, version 1.", "Licensed under the Artistic License, Version 2.0.", "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY 3.0.", "Released under the BSD License.", "Released under the MIT No Attribution License.", "Licensed under the Apache License, Version 1.1.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "This work is licensed under the GNU Lesser General Public License, version 2.1."])
def test_other_licenses_are_not_taken_for_these(text):
    assert found(text) == []


def test_every_template_is_found_as_what_it_is():
    for name, texts in TEMPLATES.items():
        for t in texts:
            assert found(f"Before. {t} After.") == [name], t
