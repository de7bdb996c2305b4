"""Text that looks like something else stays."""

import pytest

from lakeloom.llm import chat_format as chat
from lakeloom.llm.html_extraction import Page


def text(html):
    return "\n\n".join(Page(html).slots({}))


@pytest.mark.parametrize("block", ['<p class="skip-list">x y</p>', '<section class="related-items">x y</section>', '<p class="share">x y</p>', '<div id="social">x y</div>', '<p id="comments">x y</p>', '<li class="ad">x y</li>'])
@pytest.mark.parametrize("main", ["main", "article"])
def test_names_do_not_decide_inside_articles(block, main):
    assert text(f"<body><nav>menu</nav><{main}>{block}</{main}></body>") == "x y"


def test_adverts_and_comments_inside_articles_go():
    page = '<article><h1>T</h1><div class="ad">buy</div><p>body</p><aside>side</aside><section id="comments">me too</section><ul class="wide ads"><li>buy</li></ul></article><div class="share-bar">tweet</div>'
    assert text(page) == "T\n\nbody"


def test_an_unclosed_quote_ends_with_its_tag():
    assert text('<main><p title="a>b</p><p>second</p></main>') == "b\n\nsecond"
    assert text("<main><p title='it>b</p></main>") == "b"
    assert text('<main><p title="a > b">c</p></main>') == "c"


def test_heads_that_are_text_stay(spark):
    turns = [(c, t, r, x) for c in range(60) for t, r, x in ((0, "user", f"User: what is {c} and why?"), (1, "assistant", f"Assistant: it is a number like {c} others that come and go."), (2, "user", "User: is that so?"), (3, "assistant", "Assistant: yes, as far as anybody can tell from here."))]
    model = chat.fit(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    talk = [(1, 0, "User: tell me more, will you?"), (1, 1, "Assistant: Answer: 42 is what I got in the end, all told."), (1, 2, "Q: is a letter"), (2, 0, "System: be brief")]
    got = chat.parse(spark.createDataFrame(talk, "conv_id long, turn long, text string"), model).collect()
    shown = {(r.conv_id, r.turn): (r.role, r.rendered.split("\n", 1)[1].removesuffix("\n<|end|>")) for r in got}
    assert shown[1, 0] == ("user", "tell me more, will you?") and shown[1, 1] == ("assistant", "Answer: 42 is what I got in the end, all told.")
    names = dict(chat.NAMES)
    for r in got:  # a head goes only if it names the turn's role
        source = next(x for c, t, x in talk if c == r.conv_id and x.endswith(shown[r.conv_id, r.turn][1].split("\n")[-1]))
        head = source.split(":")[0].lower()
        assert (shown[r.conv_id, r.turn][1].split("\n")[-1] == source) == (chat.ROLES[names[head]] != r.role)
