import pytest
from beadframe.llm import page_diff as p


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav><svg class='i'/></nav><article><p>x</p></article>", "x"), ("<svg-icon></svg-icon><article><p>x</p></article>", "x"),
        ("<button>Menu<article><p>x</p></article>", "x"), ("<nav><button>Menu</nav><p>x</p><button>more</button><p>y</p>", "x\n\ny"),
        ("<div><video src='v'></div><p>x</p>", "x"), ("<button-group><p>x</p></button-group>", "x"), ("<title-bar></title-bar><p>x", "x"),
        ("<p>a <button>Share</button> b<svg><path/><title>t</title></svg></p><select><option>o</select><p>y", "a b\n\ny"),
        ("<svg><svg/><text>no</text></svg><p>x", "x"), ("<object><object>no</object>no</object><p>x", "x"), ("<script>never <p>closed", ""),
    ],
)
def test_elements_end_where_they_end(page, text):
    lines, kinds = p.lines_of(page)
    assert p.main_text(lines, kinds, [], []) == text
