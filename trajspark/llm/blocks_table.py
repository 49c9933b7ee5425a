"""A small labelled table of text blocks, written for this repository from invented pages.

Columns: words, link density, then both for the block before and the block after, marked, in article, beside an article; the last is 1 for main text.
"""

LABELLED = [
    # articles with headings and paragraphs of all lengths
    (9, 0.0, 1, 1.0, 55, 0.0, 0, 1, 0, 1), (55, 0.0, 9, 0.0, 80, 0.02, 0, 1, 0, 1), (80, 0.02, 55, 0.0, 3, 0.0, 0, 1, 0, 1), (3, 0.0, 80, 0.02, 40, 0.0, 0, 1, 0, 1),
    (40, 0.0, 3, 0.0, 1, 0.0, 0, 1, 0, 1), (1, 0.0, 40, 0.0, 22, 0.1, 0, 1, 0, 1), (22, 0.1, 1, 0.0, 12, 0.3, 0, 1, 0, 1), (12, 0.3, 22, 0.1, 60, 0.0, 0, 1, 0, 1),
    (60, 0.0, 12, 0.3, 0, 0.0, 0, 1, 0, 1), (2, 0.0, 0, 0.0, 2, 0.0, 0, 1, 0, 1), (2, 0.0, 2, 0.0, 3, 1.0, 0, 1, 0, 1), (6, 0.0, 4, 0.0, 8, 0.6, 0, 1, 0, 1),
    (5, 0.6, 30, 0.0, 28, 0.0, 0, 1, 0, 1), (7, 1.0, 41, 0.0, 38, 0.0, 0, 1, 0, 1), (3, 1.0, 20, 0.0, 0, 0.0, 0, 1, 0, 1), (2, 1.0, 3, 0.0, 33, 0.0, 0, 1, 0, 1),
    (150, 0.0, 7, 0.0, 90, 0.0, 0, 1, 0, 1), (4, 0.0, 60, 0.0, 6, 1.0, 0, 1, 0, 1), (1, 1.0, 25, 0.1, 14, 0.0, 0, 1, 0, 1), (10, 0.0, 6, 1.0, 11, 0.0, 0, 1, 0, 1),
    # clutter inside and outside articles
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), (2, 1.0, 1, 1.0, 8, 0.0, 1, 0, 1, 0), (8, 0.0, 2, 1.0, 9, 0.0, 1, 0, 1, 0),
    (14, 0.0, 70, 0.0, 0, 0.0, 1, 0, 1, 0), (30, 0.0, 1, 1.0, 10, 0.0, 1, 0, 1, 0), (45, 0.05, 60, 0.0, 18, 0.0, 1, 0, 1, 0), (18, 0.0, 45, 0.05, 0, 0.0, 1, 0, 1, 0),
    (25, 0.0, 40, 0.0, 33, 0.0, 1, 1, 0, 0), (6, 0.5, 33, 0.0, 20, 0.0, 1, 1, 0, 0), (60, 0.0, 25, 0.0, 70, 0.0, 1, 1, 0, 0), (3, 0.0, 44, 0.0, 52, 0.0, 1, 1, 0, 0),
    (4, 1.0, 12, 0.0, 15, 0.0, 1, 1, 0, 0), (12, 0.2, 4, 1.0, 0, 0.0, 1, 0, 1, 0), (90, 0.0, 3, 0.0, 2, 1.0, 1, 0, 1, 0), (2, 0.0, 90, 0.0, 1, 1.0, 1, 1, 0, 0),
    # pages without an article element: running text and headings
    (8, 0.0, 2, 1.0, 64, 0.0, 0, 0, 0, 1), (64, 0.0, 8, 0.0, 71, 0.05, 0, 0, 0, 1), (71, 0.05, 64, 0.0, 4, 0.0, 0, 0, 0, 1), (4, 0.0, 71, 0.05, 50, 0.0, 0, 0, 0, 1),
    (50, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 1), (3, 0.0, 50, 0.0, 35, 0.1, 0, 0, 0, 1), (35, 0.1, 3, 0.0, 20, 0.2, 0, 0, 0, 1), (20, 0.2, 35, 0.1, 2, 0.0, 0, 0, 0, 1),
    (2, 0.0, 20, 0.2, 45, 0.0, 0, 0, 0, 1), (120, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (15, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (28, 0.25, 40, 0.0, 5, 1.0, 0, 0, 0, 1),
    (1, 0.0, 33, 0.0, 27, 0.0, 0, 0, 0, 1), (6, 0.0, 0, 0.0, 30, 0.0, 0, 0, 0, 1), (18, 0.0, 9, 0.0, 1, 1.0, 0, 0, 0, 1), (5, 0.0, 16, 0.0, 0, 0.0, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (12, 0.0, 3, 0.0, 14, 0.0, 0, 0, 0, 1), (7, 0.0, 12, 0.0, 9, 0.0, 0, 0, 0, 1), (9, 0.0, 7, 0.0, 0, 0.0, 0, 0, 0, 1),
    # headings and short paragraphs next to link lists
    (4, 0.0, 2, 1.0, 18, 0.0, 0, 0, 0, 1), (3, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0, 1), (2, 0.0, 1, 1.0, 30, 0.1, 0, 0, 0, 1), (1, 0.0, 3, 1.0, 2, 0.0, 0, 0, 0, 1), (4, 0.0, 6, 1.0, 1, 1.0, 0, 0, 0, 1),
    (3, 0.0, 2, 0.9, 55, 0.0, 0, 0, 0, 1), (2, 0.0, 25, 0.0, 2, 1.0, 0, 0, 0, 1), (5, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0, 1), (3, 0.2, 4, 1.0, 33, 0.0, 0, 0, 0, 1),
    # text with much of it linked, between text
    (30, 0.5, 40, 0.0, 22, 0.0, 0, 0, 0, 1), (16, 0.5, 28, 0.0, 31, 0.1, 0, 0, 0, 1), (9, 0.55, 35, 0.0, 40, 0.0, 0, 0, 0, 1), (4, 1.0, 35, 0.0, 40, 0.0, 0, 0, 0, 1), (11, 0.65, 24, 0.2, 52, 0.1, 0, 0, 0, 1),
    # and their link lists
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (4, 1.0, 3, 1.0, 8, 0.0, 0, 0, 0, 0),
    (6, 1.0, 50, 0.0, 5, 1.0, 0, 0, 0, 0), (5, 1.0, 6, 1.0, 0, 0.0, 0, 0, 0, 0), (9, 0.8, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (7, 0.7, 9, 0.8, 4, 1.0, 0, 0, 0, 0),
    (12, 0.75, 3, 1.0, 3, 1.0, 0, 0, 0, 0), (2, 0.5, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (10, 1.0, 5, 1.0, 60, 0.0, 0, 0, 0, 0), (8, 0.9, 40, 0.0, 0, 0.0, 0, 0, 0, 0),
    (20, 0.9, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 0.67, 20, 0.9, 4, 1.0, 0, 0, 0, 0), (1, 1.0, 30, 0.0, 1, 1.0, 0, 0, 0, 0), (4, 0.75, 5, 1.0, 6, 1.0, 0, 0, 0, 0),
    # wrappers around the page whose names say clutter: the text in them, headings, and link lists
    (60, 0.0, 8, 0.0, 45, 0.02, 0.02, 0, 0, 1), (45, 0.02, 60, 0.0, 30, 0.1, 0.01, 0, 0, 1), (30, 0.1, 45, 0.02, 4, 0.0, 0.04, 0, 0, 1), (4, 0.0, 30, 0.1, 50, 0.0, 0.03, 0, 0, 1),
    (8, 0.0, 2, 1.0, 60, 0.0, 0.03, 0, 0, 1), (70, 0.0, 0, 0.0, 0, 0.0, 0.01, 0, 0, 1), (3, 0.0, 1, 1.0, 40, 0.0, 0.02, 0, 0, 1), (20, 0.0, 35, 0.0, 2, 1.0, 0.04, 0, 0, 1),
    (2, 1.0, 1, 1.0, 3, 1.0, 0.02, 0, 0, 0), (6, 1.0, 50, 0.0, 5, 1.0, 0.03, 0, 0, 0), (4, 1.0, 3, 1.0, 8, 0.0, 0.02, 0, 0, 0), (10, 1.0, 5, 1.0, 60, 0.0, 0.04, 0, 0, 0),
    (40, 0.0, 30, 0.0, 50, 0.0, 0.02, 0, 0, 1), (6, 0.0, 40, 0.0, 30, 0.0, 0.02, 0, 0, 1), (30, 0.0, 12, 0.0, 6, 0.0, 0.01, 0, 0, 1), (5, 0.0, 0, 0.0, 35, 0.0, 0.02, 0, 0, 1),
    (9, 0.0, 25, 0.0, 0, 0.0, 0.03, 0, 0, 1), (16, 0.0, 30, 0.0, 0, 0.0, 0.01, 0, 0, 1), (2, 0.0, 0, 0.0, 12, 0.0, 0.01, 0, 0, 1), (12, 0.0, 2, 0.0, 9, 0.0, 0.01, 0, 0, 1),
    # a lone notice
    (3, 0.0, 0, 0.0, 0, 0.0, 0.01, 0, 0, 0), (12, 0.0, 0, 0.0, 0, 0.0, 0.01, 0, 0, 0), (7, 0.0, 0, 0.0, 1, 1.0, 0.02, 0, 0, 0),
    # comments and notices, large ones too, on pages without an article element
    (60, 0.0, 25, 0.0, 70, 0.0, 0.08, 0, 0, 0), (25, 0.0, 30, 0.0, 40, 0.0, 0.12, 0, 0, 0), (45, 0.0, 60, 0.0, 20, 0.0, 0.3, 0, 0, 0), (30, 0.0, 12, 0.0, 40, 0.0, 0.6, 0, 0, 0),
    (90, 0.0, 3, 0.0, 2, 1.0, 0.9, 0, 0, 0), (15, 0.0, 50, 0.0, 0, 0.0, 0.97, 0, 0, 0),
    # and much longer ones beside or in a short article
    (60, 0.0, 20, 0.0, 45, 0.0, 0.02, 0, 1, 0), (30, 0.0, 60, 0.0, 12, 0.0, 0.04, 0, 1, 0), (9, 0.0, 30, 0.0, 50, 0.0, 0.01, 0, 1, 0),
    (60, 0.0, 20, 0.0, 45, 0.0, 0.02, 1, 0, 0), (8, 0.0, 60, 0.0, 40, 0.0, 0.03, 1, 0, 0), (35, 0.0, 8, 0.0, 30, 0.0, 0.04, 1, 0, 0),
]
