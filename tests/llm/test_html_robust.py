"""Pages that are broken, hostile or laid out by spans and style sheets; every one is read in linear time."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html


@pytest.mark.parametrize("unit", ["<b xxxx ", "<b x='", '<a "', "<div>", "</p", "<!x", "<p>if x <y then ", "<a b=\"' ", "<![CDATA[ ", "<!-- x ", "<ul><li>x", "<blockquote>x", "<table><tr><td>x", "<td rowspan=9>x", "<td colspan=1000>x", "<p style='x'>", "<style>p{display:block}</style><p>"])
def test_a_megabyte_is_read_in_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.time()
    html.extract(page[: len(page) // 4])
    middle = time.time()
    html.extract(page)
    assert time.time() - middle < 8 * (middle - began) + 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a <b " + "x" * 10_000, "a <b " + "x" * 10_000),
        ("<p>if x <y then word</p>z", "if x z"),
        ("<a title='x>y>link</a> z", "y>link z"),
        ("<p it's>don't</p>", "don't"),
        ("a < b & c </ x>d<!>e<?f>g", "a < b & c deg"),
        ('<table><tr><td colspan="²">a<td>b<tr><td colspan="' + "9" * 5000 + '">c</table>', "a  b\nc"),
        ("<table><tr><td rowspan=2>tall<td>b<tr><td>c<tr><td>d<td>e</table>", "tall  b\n      c\nd     e"),
        ("<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3</table>", "x  1\n   2\n   3"),
        ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>c</table>", "wide one  x\na  b  c"),
        ("<style>.no{display:none} #v, q.x {visibility:hidden} /* p{display:none} */ @media print{p{display:none}}</style><p>a<b class='y no'>b</b><i id=v>c<u style='visibility:visible'>d</u></i><q class=x>e</q><q>f</q>", "adf"),
        ("<style>p{display:none} p.on{display:block} i{display:none!important}</style><p>a<p class=on>b<i style='display:inline'>c</i>", "b"),
        ("<style>b{display:none", ""),
        ("<b style='display:none;display:inline'>a</b>", "a"),
        ("<table><tr><td>a<table><tr><td>b<td>c<tr><td>d</table>e<td>f</table>", "a b c d e  f"),
        ("<!-->a<!--->b<!-- c", "ab"),
        ("", ""),
    ],
)
def test_pages(page, text):
    assert html.extract(page) == text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("<p> <b x='y'> <b <a </p> </b> ' \" > = / <td> <tr> <table> </table> <li> <ul> </ul> word & < <!-- --> <div hidden> </div> <td rowspan=2> <style> </style> p{display:none} <br>".split()), max_size=25).map("".join))
def test_any_page_is_read(page):
    text = html.extract(page)
    assert isinstance(text, str) and text == text.strip("\n") and "\n\n\n" not in text


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, html string, text string, url string")


def test_empty_table_repeated_rows_and_long_pages(spark):
    assert html.extracted(table(spark, [])).collect() == []
    long = "<p>word</p>" * 200_000
    rows = [(1, "<p>a</p>", "x", None), (1, "<p>a</p>", "x", None), (2, long, None, None), (None, None, None, None)]
    got = sorted(map(tuple, html.extracted(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "a"), (1, "a"), (2, "\n\n".join(["word"] * 200_000)), (None, None)], key=str)
