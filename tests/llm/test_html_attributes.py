"""Layout words and other attributes do not make an article boilerplate; real boilerplate stays so."""

import pytest

from factloom.llm import html_extract

ARTICLE = " ".join(f"This is sentence {i} of a long article about rivers and towns." for i in range(10))
PAGE = "<html><body {body}><div class='sidebar'><p>Links and more links here.</p></div><article {article}><p>{text}</p></article><div class='footer'><p>Imprint and terms.</p></div></body></html>"


@pytest.mark.parametrize(
    "body, article",
    [
        ("class='single with-sidebar'", ""), ("class=has-sidebar", ""), ("id='page' class='single-post comments-open sidebar'", ""), ("", "class='post has-sidebar'"), ("", "class='content no-comments sidebar-right'"),
        ("", "title='a hidden place'"), ("", "data-id='related'"), ("", "data-class=\"ad\" data-role='navigation'"), ("data-style='display:none'", "data-hidden"),
    ],
)
def test_article_is_kept_and_nothing_else(body, article):
    assert html_extract.extract(PAGE.format(body=body, article=article, text=ARTICLE)) == ARTICLE


@pytest.mark.parametrize("attributes", ["class='comment'", "class=related", "id='sidebar-right-ads'", "hidden", "HIDDEN", "aria-hidden = 'true'", "style='display: none'", "title='x' class=\"ad\"", "data-x=/a/b id=promo", "class='is-hidden'"])
def test_real_boilerplate_still_goes(attributes):
    text = html_extract.extract(f"<body><main><p>{ARTICLE}</p></main><article {attributes}><p>Buy this now and win a prize today.</p></article></body>")
    assert text == ARTICLE
