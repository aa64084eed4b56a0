"""URL filter: host and path rules first, a weighted vocabulary for the rest.

Rules name a host and the beginning of a path; a rule fits its host and all subdomains, and
of the fitting rules the longest decides. Where none fits, an Aho-Corasick automaton counts
vocabulary terms in the lower-cased URL. A term counts only between boundaries: no letter
may touch it on either side. One strict term, or several distinct soft terms whose weights,
each term once, reach ``ENOUGH``, block the URL; one soft term never does.

Both work row by row in Arrow batches; rules and terms are parameters of bounded size that
travel with the task, so there is no join and no shuffle.

Nulls and odd rows: a null URL, or one without ``://``, has an empty host and path and no
rule (a null URL has no terms either, so it is allowed); a null id is passed on; repeated
rows are judged once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

ENOUGH = 2.0

# Production vocabulary, one strict hit or several soft hits worth ENOUGH; every soft weight is below it.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirl", "camgirls", "escort", "escorts", "nsfw", "sexcam", "warez", "onlinecasino")
SOFT = {
    "adult": 1.0, "bet": 1.0, "betting": 1.0, "casino": 1.0, "cheap": 0.5, "click": 0.5, "coupon": 0.5, "dating": 1.0,
    "free": 0.5, "gambling": 1.0, "girls": 1.0, "hot": 0.5, "jackpot": 1.0, "loan": 1.0, "lottery": 1.0, "nude": 1.0,
    "pills": 1.0, "poker": 1.0, "promo": 0.5, "sexy": 1.0, "slots": 1.0, "spam": 1.0, "torrent": 1.0, "win": 0.5,
}

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, text: str, verdict: str) -> Rule:
        """``host/path`` as written in a list."""
        host, slash, rest = text.partition("/")
        return cls(host.translate(_UPPER), slash + rest, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule.parse("com/", "allow"),
    Rule.parse("example.com/en/", "block"),
    Rule.parse("www.example.com/en/", "allow"),
    Rule.parse("net/es/", "block"),
    Rule.parse("net/fr/", "block"),
)


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_UPPER), slash + path


def deciding(host: str, path: str, rules: Mapping[str, Sequence[Rule]]) -> Rule | None:
    """The longest fitting rule; ``rules`` by host. Of rules that say the same, the first."""
    best = None
    labels = host.split(".")
    for at in range(len(labels)):
        for rule in rules.get(".".join(labels[at:]), ()):
            if path.startswith(rule.path) and (best is None or len(rule.text) > len(best.text)):
                best = rule
    return best


def automaton(strict: Sequence[str], soft: Mapping[str, float]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in {**soft, **dict.fromkeys(strict, None)}.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def hits(url: str, terms) -> tuple[set[str], dict[str, float]]:
    """Distinct strict terms and soft terms with their weights that stand between boundaries."""
    low = url.translate(_UPPER)
    strict, soft = set(), {}
    if not len(terms):
        return strict, soft
    for last, (term, weight) in terms.iter(low):
        begin = last + 1 - len(term)
        if (begin and low[begin - 1].isalpha()) or (last + 1 < len(low) and low[last + 1].isalpha()):
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return strict, soft


def judge(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Mapping[str, float] = SOFT,
    enough: float = ENOUGH,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, strict_hits, soft_hits."""
    if any(not t for t in (*strict, *soft)):
        raise ValueError("a term can't be empty")
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    strict, soft = tuple(strict), dict(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("url").to_pylist():
                host, path = parts(text)
                rule = deciding(host, path, by_host)
                hard, mild = hits(text or "", terms)
                bad = bool(hard) or (len(mild) > 1 and sum(mild.values()) >= enough)
                verdict = rule.verdict if rule else "block" if bad else "allow"
                out.append((host, path, rule and rule.text, verdict, len(hard), len(mild)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(),) * 4 + (pa.int32(),) * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"],
            )

    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")

