"""Names inside an article that hold a boilerplate word but mark real text."""

import pytest

from pointloom.llm import html_text

PAGE = "<body><nav>Menu</nav><article><h1>Title</h1><p>First words of the text, long enough.</p>{}<p>Last words of the text, as long.</p></article></body>"


@pytest.mark.parametrize("inner", [
    '<h2 id="related-work">Kept text</h2>', '<h3 id="legal-basis">Kept text</h3>', '<section id="discussion"><p>Kept text</p></section>',
    '<p class="side-note">Kept text</p>', '<div class="overflow-hidden"><p>Kept text</p></div>', '<p>Kept <span id="search-cost">text</span></p>', '<section id="related"><p>Kept text</p></section>',
])
def test_text_with_unlucky_names_stays(inner):
    assert "Kept text" in html_text.extract(PAGE.format(inner)).split("\n")


@pytest.mark.parametrize("inner", [
    '<div class="ad">Gone</div>', '<div class="c-share-bar">Gone</div>', '<div id="comments">Gone</div>', '<ul class="related-posts"><li>Gone</li></ul>', '<div class="post-comments">Gone</div>',
    '<p class="hidden">Gone</p>', '<div role="navigation">Gone</div>', '<div id="div-gpt-ad-12">Gone</div>', '<div class="side-bar">Gone</div>', '<div id="disqus_thread">Gone</div>',
])
def test_boilerplate_in_an_article_goes(inner):
    assert "Gone" not in html_text.extract(PAGE.format(inner))
