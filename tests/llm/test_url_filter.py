import pytest

from gleanery.llm import url_filter as U

COLUMNS = "page_id long, url string, verdict string, host string"


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        (None, "", ""), ("", "", ""), ("example.com/en/", "", ""), ("http://A.Com", "a.com", ""), ("http://a.com/X?y=/z#/w", "a.com", "/X"),
        ("http://a.com?x=/en/", "a.com", ""), ("x://", "", ""), ("http://a://b/c", "a:", "//b/c"), ("http://a.com#t/", "a.com", ""), ("://h/p", "h", "/p"),
        ("http://É.Com/", "É.com", "/"),
    ],
)
def test_parts(url, host, path):
    assert U.parts(url) == (host, path)


def rule_of(url):
    by = {}
    for r in U.RULES:
        by.setdefault(r.host, []).append(r)
    found = U.deciding(*U.parts(url), by)
    return found and (found.text, found.verdict)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://a.com/", ("com/", "allow")), ("http://a.com", None), ("http://com/x", ("com/", "allow")), ("http://acom/x", None),
        ("http://example.com/en/1", ("example.com/en/", "block")), ("http://m.example.com/en/", ("example.com/en/", "block")),
        ("http://m.example.com/en", ("com/", "allow")), ("http://notexample.com/en/", ("com/", "allow")),
        ("http://www.example.com/en/2", ("www.example.com/en/", "allow")), ("http://x.www.example.com/en/2", ("www.example.com/en/", "allow")),
        ("http://a.net/es/", ("net/es/", "block")), ("http://a.net/fr/x", ("net/fr/", "block")), ("http://a.net/de/", None),
        ("http://a.com:80/", None), ("a.com/", None),
    ],
)
def test_longest_rule(url, want):
    assert rule_of(url) == want


def brute_blocked(url):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)

    def stands(term):
        return any(
            low.startswith(term, i) and not (i and low[i - 1].isalpha()) and not low[i + len(term) : i + len(term) + 1].isalpha()
            for i in range(len(low))
        )

    return any(map(stands, U.STRICT)) or sum(w for t, w in U.SOFT.items() if stands(t)) >= U.ENOUGH


URLS = [
    "http://porn.org/", "http://popcorn.org/", "http://xporn.org/", "http://a.org/PORN-1", "http://a.org/casino", "http://a.org/casino/casino/casino",
    "http://a.org/casino/poker", "http://a.org/free-win-hot-cheap", "http://a.org/free-win-hot", "http://a.org/betting", "http://a.org/bet1ting/adult2",
    "http://a.org/éporn", "http://a.org/porno", "no mark xxx", "", "http://a.org/" + "x/" * 50_000 + "xxx",
]


def test_vocabulary_equals_brute_force(spark):
    rows = [(i, u, "z", None) for i, u in enumerate(URLS)] + [(None, None, None, None), (0, URLS[0], "again", "h")]
    got = U.judge(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == len(rows)
    for r in got:
        url = "" if r.page_id is None else URLS[r.page_id]
        assert r.rule is None and r.verdict == ("block" if brute_blocked(url) else "allow"), url[:60]


def test_other_parameters_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/spam", "", "")], COLUMNS)
    assert U.judge(pages, strict=("spam",), soft={}).first().verdict == "block"
    assert U.judge(pages, strict=(), soft={}, rules=()).first().verdict == "allow"
    assert U.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        U.judge(pages, strict=("",))


def test_one_soft_term_never_blocks(spark):
    assert max(U.SOFT.values()) < U.ENOUGH
    urls = [f"http://a.org/{t}-education/{t}/" for t in U.SOFT] + ["http://a.org/adult/casino"]
    pages = spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls)], COLUMNS)
    want = ["allow"] * len(U.SOFT) + ["block"]
    for soft in (U.SOFT, dict.fromkeys(U.SOFT, 5.0)):
        assert [r.verdict for r in U.judge(pages, soft=soft).orderBy("page_id").collect()] == want
