"""Pages framed by elements whose names would leave them out, and pages in other languages."""

from __future__ import annotations

import os
import re

import pyarrow.parquet as pq
import pytest

from larkspur.llm import html_text

ENGLISH = [
    "This is the story of a page that is as long as it has to be, and it was told in a plain division because the template of the site has its own names for what it shows to those who read it.",
    "And here is what came after that: the names of the elements around it were no help at all to those who had to find out which of them had the story and which had what is sold beside it, day after day.",
]
OTHERS = {
    "zh": ["这是一个很长的段落，讲述了一个关于城市和河流的故事。人们每天早上都会来到河边散步，孩子们在树下玩耍，老人们坐在长椅上聊天。这里的生活很平静，大家都很喜欢这个地方。", "到了晚上，城市里的灯都亮了起来，街上有很多人。他们在餐馆里吃饭，在商店里买东西，然后慢慢地走回家去。明天早上，同样的故事又会重新开始，一天又一天。"],
    "ru": ["Это длинный абзац, в котором рассказывается история о городе и реке. Каждое утро люди приходят на берег, чтобы гулять под старыми деревьями. Дети играют возле воды, а старики сидят рядом и спокойно разговаривают.", "Вечером в городе зажигаются огни, и улицы наполняются людьми. Они ужинают в маленьких ресторанах, покупают подарки и медленно возвращаются домой. Завтра утром всё начнётся снова, как начиналось всегда."],
    "pl": ["Ten długi akapit opowiada historię miasta nad rzeką. Każdego ranka mieszkańcy przychodzą nad brzeg, żeby spacerować pod starymi drzewami. Dzieci bawią się obok wody, natomiast starsi ludzie siedzą spokojnie i rozmawiają.", "Wieczorem zapalają się latarnie i ulice zapełniają się ludźmi. Jedzą kolację w małych restauracjach, kupują prezenty i powoli wracają do swoich domów. Jutro rano wszystko zacznie się od początku, tak samo jak zawsze."],
}
MENU = '<div class="menu"><a href="/1">Start</a> <a href="/2">About all of us</a> <a href="/3">What we do for you</a></div>'
END = '<footer>© all of us</footer>'
COMMENTS = '<section class="comments"><p>' + "This is the best of all the stories that I have ever had the chance to read, and I will come back for more of them as soon as I can. " * 4 + "</p></section>"


def body(paragraphs):
    return "".join(f"<p>{p}</p>" for p in paragraphs)


@pytest.mark.parametrize("frame", ['div id="page" class="has-sidebar sidebar-left"', 'div class="sidebar"', 'form id="aspnetForm" action="/"', "fieldset", 'div class="layout with-comments"', 'div role="search"'])
@pytest.mark.parametrize("inner", ["article", "main", 'div class="content"', "div"])
def test_frames_are_not_left_out(frame, inner):
    page = f"<body>{MENU}<{frame}><{inner}>{body(ENGLISH)}</{inner.split()[0]}>{COMMENTS}</{frame.split()[0]}>{END}</body>"
    assert html_text.main_text(page) == " ".join(ENGLISH)


@pytest.mark.parametrize("word", ["share", "social", "related", "comment", "search", "notice", "alert", "sponsor"])
def test_sections_of_an_article_with_longer_names_stay(word):
    page = f'<body>{MENU}<article><p>{ENGLISH[0]}</p><section class="{word}-policy"><p>{ENGLISH[1]} {ENGLISH[1]}</p></section></article>{END}</body>'
    assert html_text.main_text(page) == " ".join([ENGLISH[0], ENGLISH[1], ENGLISH[1]])
    for name in (word, f"{word}-box", f"entry-{word}"):
        page = f'<body>{MENU}<article><p>{ENGLISH[0]}</p><section class="{name}"><p>{ENGLISH[1]} {ENGLISH[1]}</p></section></article>{END}</body>'
        assert html_text.main_text(page) == ENGLISH[0], name


def test_what_is_beside_the_text_is_left_out_still():
    side = f'<div class="sidebar"><p>{ENGLISH[1]}</p></div>'
    fields = '<form><label>Mail</label><input name="m"><button>Go</button><p>Write to us.</p></form>'
    assert html_text.main_text(f"<body>{side}<div><p>{ENGLISH[0]}</p><p>{ENGLISH[0]}</p></div>{fields}{COMMENTS}{END}</body>") == f"{ENGLISH[0]} {ENGLISH[0]}"
    replies = f'<div id="comments"><article class="comment"><p>{ENGLISH[1]}</p></article></div>'
    assert html_text.main_text(f"<body><article><p>{ENGLISH[0]}</p></article>{replies}</body>") == ENGLISH[0]


@pytest.mark.parametrize("lang", sorted(OTHERS))
def test_languages_without_known_stop_words(lang):
    page = f"<body>{MENU}<div>{body(OTHERS[lang])}</div>{END}</body>"
    assert html_text.main_text(page) == " ".join(OTHERS[lang])
    mixed = f"<body>{MENU}<div>{body([ENGLISH[0], *OTHERS[lang], ENGLISH[1]])}</div>{END}</body>"
    assert html_text.main_text(mixed) == " ".join([ENGLISH[0], *OTHERS[lang], ENGLISH[1]])


def one_level(html):
    """What stands in article or main elements, by a plain walk over tags: names that leave an
    element out remove it up to its end."""
    from html.parser import HTMLParser

    out, stack = [], []

    class Walk(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "br":
                out.append(" ")
            if tag not in html_text.VOID:
                text = " ".join(f'{k}="{v}"' for k, v in attrs if v)
                gone = tag in html_text.RAW or html_text.is_left_out(tag, text, any(t in ("article", "main") for t, _ in stack))
                stack.append((tag, gone))
            if tag not in html_text.INLINE:
                out.append(" ")

        def handle_endtag(self, tag):
            while stack and any(t == tag for t, _ in stack):
                if stack.pop()[0] == tag:
                    break
            if tag not in html_text.INLINE:
                out.append(" ")

        def handle_data(self, data):
            if any(t in ("article", "main") for t, _ in stack) and not any(g for _, g in stack):
                out.append(data)

    walk = Walk(convert_charrefs=True)
    walk.feed(html)
    walk.close()
    return "".join(out).split()


PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables")
def test_pages_against_a_plain_walk_and_without_their_marks():
    pages = [h or "" for h in pq.read_table(PAGES)["html"].to_pylist()]
    texts = [html_text.main_text(h) for h in pages]
    walked = sum(one_level(h) == t.split() for h, t in zip(pages, texts))
    bare = [html_text.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", h, flags=re.I)) for h in pages]
    kept = sum(all(part in b for part in t.split(". ")) for t, b in zip(texts, bare))
    assert (walked >= 0.9 * len(pages), kept >= 0.996 * len(pages)) == (True, True), (walked, kept, len(pages))
