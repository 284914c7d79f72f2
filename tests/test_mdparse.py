"""Vectors for the one-pass reader of Markdown; each was worked out by hand from the dialect named, no program gave them."""

import time

import pytest

from corpusloom.functions import mdparse as P


def found(text):
    return {k: v for k, v in P.Elements(text).n.items() if v}


@pytest.mark.parametrize(
    "text, tags",
    [  # a converter to HTML with tables and fenced code
        ("Title\n=====", {"h1": 1}),
        ("Title\n---\ntext", {"h2": 1, "p": 1}),
        ("#Title\ntext\n## B", {"h1": 1, "h2": 1, "p": 1}),
        ("__bold__ _em_ snake_case_x", {"strong": 1, "em": 1, "p": 1}),
        ("***x*** `a` ``b ` c`` <b>z</b> <i>q</i> <http://x.y> ![i](u) [l](u)", {"b": 1, "strong": 1, "i": 1, "em": 1, "code": 2, "p": 1, "a": 2}),
        ("x <math>y</math>", {"math": 1, "p": 1}),
        ("- a\n    - b\n- c", {"ul": 2, "li": 3}),
        ("- a\n\n- b\n\n- c", {"ul": 1, "li": 3, "p": 3}),
        ("1. one\n2. two\n\n3. three\n\nEnd.", {"ol": 1, "li": 3, "p": 3}),
        ("p1\n- not list", {"p": 1}),
        ("a | b\n--- | ---\n1 | 2", {"table": 1, "tr": 2, "th": 2, "td": 2}),
        ("| a |\n| --- |\n| 1 |\n| 2 |", {"table": 1, "tr": 3, "th": 1, "td": 2}),
        ("a | b\nno rule | x", {"p": 1}),
        ("> q\n> w\n\nx", {"blockquote": 1, "p": 2}),
        ("text\n***\nmore", {"hr": 1, "p": 2}),
        ("~~~\n# x\n~~~\n\n```py\ny\n```", {"pre": 2, "code": 2}),
        ("```\nunclosed", {"p": 1}),
        ("    code\n\ntext", {"pre": 1, "code": 1, "p": 1}),
        ("<div>raw <b>x</b></div>", {"b": 1}),
        ("[l][id] [m][no]\n\n[id]: http://x", {"a": 1, "p": 1}),
        (r"\*no\* and \_no\_", {"p": 1}),
        ("", {}),
    ],
)
def test_elements(text, tags):
    assert found(text) == tags


@pytest.mark.parametrize(
    "text, n",
    [  # CommonMark
        ("# A\n\n### B\n\n# C\n\n## D", 1),
        ("# A\n\n```\n###### x\n```", 0),
        ("# A\n\n~~~\n###### x\n~~~\n\n#### B", 1),
        ("# A\n\n    ###### x", 0),
        ("#A\n\n### B", 0),
        ("A\n=\n\n### B", 1),
        ("---\nt: 1\n---\n\n#### B", 1),
        ("> # A\n> ### B", 1),
        ("- # A\n- ### B", 1),
        ("<div>x</div>\n\n<!-- TABLE_ANCHOR_p1_t1 -->\n\n<!-- other -->", 2),
        ("text <b>inline</b>", 0),
        ("<b>alone</b> x", 0),
        ("<custom>\nx\n\ny", 1),
    ],
)
def test_violations(text, n):
    assert P.violations(text) == n


@pytest.mark.parametrize(
    "text, rate",
    [  # a splitter by lines under headings of levels 1 to 4
        ("", 1.0),
        ("pre\n# A\ntext\n# B\nmore", 1 / 3),
        ("# A\nx\n```\n# not a heading\n```\ny", 0.0),
        ("x\n```\n# A\n```\n# B\ny", 0.5),
        ("# A\n\nx\n\n## B\n\ny\n\n## B\n\nz", 0.0),
        ("##### five\nx", 1.0),
        ("---\ntitle: x\n---\n# A\ny", 0.0),
        ("#\nx", 0.0),
    ],
)
def test_orphans(text, rate):
    assert P.orphans(text) == pytest.approx(rate)


@pytest.mark.parametrize(
    "text, invalid",
    [  # YAML
        ("---\ntitle: x\n---\nbody", 0.0),
        ("---\nsource_file: a: b\n---\n", 1.0),
        ("---\nprocessing-date: 1\nitems:\n  - x\n---\n", 0.0),
        ("---\nplain\n---\n", 1.0),
        ("---\n- a\n---\n", 1.0),
        ("---\n---\n", 1.0),
        ("---\ntitle: x\n", 1.0),
        ("body", 1.0),
    ],
)
def test_front_matter(text, invalid):
    if P.yaml is None:
        pytest.skip("no YAML loader here")
    assert P.front_matter_invalid(text) == invalid


@pytest.mark.parametrize("junk", ["_a ", "**a ", "`", "```\n", "> ", "- ", "#", "[a", "<a ", "|a", "\n- x", "    - x\n", "a\n# b\n", "a\n---\n", "<!--", "a\n***\n", "a\n> b\n", "> a\n\n", "    x\ny\n", "[a]: b\n"])
def test_the_pass_is_linear(junk):
    text = junk * (300_000 // len(junk))
    began = time.time()
    P.profile(text)
    assert time.time() - began < 8


def test_null_is_empty():
    assert P.profile(None) == P.profile("")
