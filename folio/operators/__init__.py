"""DataFrame operators on pixels, lines, outlines, pages and catalogues."""
