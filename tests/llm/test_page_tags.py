import pytest

from seclog.llm import pages


@pytest.mark.parametrize("page,text", [
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</article>", "Let x=1 be"),
    ("<article><p>Open <svg><path d=m>here<p>Second one<p>Third one</article>", "Open here\n\nSecond one\n\nThird one"),
    ("<article><p>An <svg><path d='m 1'/></svg> icon</article>", "An icon"),
    ("<article><p>A chart <object data=x>in other words</object> follows</article>", "A chart in other words follows"),
    ("<article><p>One <noscript>two</noscript> three <iframe src=x>four<p>Five</article>", "One two three four\n\nFive"),
])
def test_embedded_parts_keep_their_text(page, text):
    assert pages.main_text(page) == text
