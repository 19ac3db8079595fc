"""Nesting has no limit: what is deep is read like what is not."""

import time

import pytest

from tessera.llm import html

DEEP = [199, 200, 201, 5000]


@pytest.mark.parametrize("n", DEEP)
@pytest.mark.parametrize("tag", ["font", "b", "span"])
def test_deep_elements_render_as_shallow_ones(n, tag):
    inner = "<ul><li>a<li>b<ol><li>c</ol></ul><table><tr><th>Name<th>N<tr><td>a<td>10</table>z<p hidden>no</p><template>no</template><i style='display:none'>no</i><b>y</b>"
    shallow = html.extract(inner)
    assert shallow == "- a\n- b\n  1. c\n\nName  N\na     10\n\nzy"
    assert html.extract(f"<{tag}>" * n + inner) == shallow
    assert html.extract(f"x<div><{tag}>" * n + "<i>y</i></div>z").split() == ["x"] * n + ["y", "z"]


def test_end_tags_close_their_own_elements():
    page = "<div hidden>" + "<span>" * 300 + "<div>no</div>no</div>yes"
    assert html.extract(page) == "yes"


def test_deep_tables_and_lists():
    assert html.extract("<table><tr><td>" * 1500 + "x" + "</table>" * 1500) == "x"
    lists = html.extract("<ul><li>" * 400 + "x").split("\n")
    assert len(lists) == 1 and lists[0].endswith("- x")


def test_unclosed_tags_cost_linear_time():
    began = time.time()
    assert html.extract("<table><tr><td>" + "<font>" * 50_000 + "<div>x</div>" * 50_000).count("x") == 50_000
    assert time.time() - began < 30
