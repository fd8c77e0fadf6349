from faultline.llm import language
from tests.llm.conftest import frame

VOICE = {"aa": "bako deru mila sonu kepa", "bb": "xwrt zkpt qrstn vlkt mrrk", "cc": "éèlou çaîn ûmê œvré àlù"}
PAGES = "page_id long, url string, html string, host string, lang string, logs int"


def teach(spark, rng):
    return frame(spark, [(i, " ".join(rng.choice(VOICE[k].split()) for _ in range(40)), k) for i, k in enumerate(list(VOICE) * 20)] + [(900, None, "aa"), (901, "x", None)])


def page(rng, lang, declared, n=40):
    body = " ".join(rng.choice(VOICE[lang].split()) for _ in range(n))
    return f'<!DOCTYPE html><html lang="{declared}"><head><title>{VOICE["bb"]}</title></head><body><nav>{VOICE["cc"]}</nav><script>aa bb</script><p>{body}</p></body></html>'


def test_text_beats_a_wrong_declaration_and_weak_text_takes_the_rest(spark, rng):
    rows = []
    for i in range(150):
        k = list(VOICE)[i % 3]
        rows.append((i, f"http://{k}.site{k}.org/{k}/x{i}", page(rng, k, k), None, None, 0))
    rows.append((500, "http://aa.siteaa.org/x", page(rng, "aa", "cc"), None, None, 0))
    rows.append((501, "http://bb.sitebb.org/bb/y", '<html lang="bb"><body>1 2</body></html>', None, None, 0))
    rows.append((502, "http://new.sitecc.org/", "<p></p>", None, None, 0))
    rows += [(503, None, None, None, None, 0), (None, "", "", None, None, 0), (0, *rows[0][1:])]
    got = language.identify(spark.createDataFrame(rows, PAGES), teach(spark, rng)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].lang == list(VOICE)[i % 3] for i in range(150))
    assert by[500].lang == "aa" and by[500].declared == "cc"
    assert by[501].lang == "bb" and by[502].lang == "cc" and by[502].text_lang is None
    assert by[503].lang in VOICE and by[None].lang in VOICE
    assert all(0 < r.probability <= 1 for r in got)


def test_addresses():
    assert language.address("https://m.blog.site.co.uk:80/fr/1?x#y") == ("m.blog.site.co.uk", "co.uk", "uk/fr")
    assert language.address("http://Site.org") == ("site.org", "site.org", "org")
    assert language.address("") == ("", "", "")


def test_no_languages_and_empty(spark, rng):
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>bako</p>", None, None, 0)], PAGES)
    assert [tuple(r)[:2] for r in language.identify(pages, frame(spark, [])).collect()] == [(1, None)]
    assert language.identify(pages.limit(0), teach(spark, rng)).count() == 0


def test_a_declaration_counts_wherever_it_stands(spark, rng):
    long = "licence " * 2_000
    pages = {
        1: f'<!-- {long} --><html lang="cc"><body>1</body></html>',
        2: f'<!DOCTYPE html {long}><HTML\n data-x="{long}" LANG = cc><body>1</body></html>',
        3: '<!-- <html lang="aa"> --><script>"<html lang=aa>"</script><html lang="cc"><body>1</body></html>',
        4: "<html><body>1</body></html>",
    }
    got = language.identify(spark.createDataFrame([(i, None, x, None, None, 0) for i, x in pages.items()], PAGES), teach(spark, rng)).collect()
    assert {r.page_id: r.declared for r in got} == {1: "cc", 2: "cc", 3: "cc", 4: ""}
    assert language.declared("<html " * 200_000) == language.declared("<!--" * 200_000) == ""  # read once


def test_pages_are_read_once():
    import random
    import re
    import time
    plain = re.compile(r"(?is)<(script|style|nav|footer|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(8)
    parts = ["<nav>", "</nav>", "<NAV a>", "</Nav >", "<!--", "-->", "<script", "</script>", "<header>", "</head>", "<head>", "<", ">", "<p>", "text", " ", "--", "<footer>", "\n"]
    for _ in range(4000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        assert language.without_markup(page) == plain.sub(" ", page), page
    for part in ("<nav>", "<!--", "<", "<script>x</nav>", "<head", "</nav "):
        began = time.time()
        language.visible(part * (1_000_000 // len(part)))
        assert time.time() - began < 3, part
