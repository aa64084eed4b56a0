import random

import pytest

from gleanery.llm import line_dedup


def brute(rows, least):
    """Every run of lines with enough words that stands at an earlier place goes. Only for small texts."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda d: d[:2])
    split = [[" ".join(x.split()) for x in d[2].split("\n")] for d in docs]
    seen, gone = {}, [set() for _ in docs]
    spans = []
    for d, lines in enumerate(split):
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b].split())
                if words >= least and lines[a] and lines[b]:
                    spans.append((d, a, b, tuple(lines[a : b + 1])))
    for d, a, b, run in spans:
        seen[run] = min(seen.get(run, (d, a)), (d, a))
    for d, a, b, run in spans:
        if seen[run] < (d, a):
            gone[d] |= set(range(a, b + 1))
    for lines, g in zip(split, gone, strict=True):
        for a, b in zip(sorted(g), sorted(g)[1:], strict=False):
            if not any(lines[a + 1 : b]):
                g |= set(range(a, b))
    out = {}
    for (late, i, t), g in zip(docs, gone, strict=True):
        out[(None if late else i, t)] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g)
    return out


def run(documents, rows, least):
    got = line_dedup.dedup(documents(rows).withColumnsRenamed({"lang": "runs", "source": "content"}), least=least).collect()
    assert len(got) == len(rows)
    return got


def texts(seed, docs=30):
    rng = random.Random(seed)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 5))) for _ in range(25)]
    shared = [rng.choices(lines, k=rng.randint(2, 6)) for _ in range(5)]
    out = []
    for i in range(docs):
        body = []
        for _ in range(rng.randint(0, 5)):
            body += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(lines) + str(rng.random()) for _ in range(rng.randint(1, 4))]
        out.append((i, "\n".join(body)))
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 6), (2, 10), (3, 3)])
def test_equals_brute_force(documents, seed, least):
    rows = texts(seed)
    want = brute(rows, least)
    got = run(documents, rows, least)
    assert {r.doc_id: r.text for r in got} == {i: t for (i, _), t in want.items()}
    assert any(r.removed_lines for r in got)
    for r in got:
        assert sum(x.last - x.first + 1 for x in r.runs) == r.removed_lines
        if r.removed_lines < r.n_lines:
            assert r.text.count("\n") + 1 == r.n_lines - r.removed_lines


def test_long_passages_and_odd_rows(documents):
    passage = " ".join(f"w{i}" for i in range(60))
    half = "\n".join(" ".join(f"v{i}{k}" for i in range(26)) for k in range(2))
    rows = [
        (5, f"intro\n{passage}\nend"), (2, f"other intro\n  {passage.replace(' ', '  ')} \nother end"), (9, half + "\ntail"), (7, "head\n" + half),
        (8, half.split("\n")[0] + "\nshort run only"), (None, passage), (1, None), (3, ""), (3, ""), (11, "\n\n\n"), (12, "same line of words " * 20 + "\n" + "same line of words " * 20),
        (20, "\n".join(["x y z"] * 5000)), (21, "Licence\n" * 3),
    ]
    got = {(r.doc_id, r.n_lines): r for r in run(documents, rows, 50)}
    text = {i: r.text for (i, _), r in got.items()}
    assert text[2] == rows[1][1] and text[5] == "intro\nend" and text[None] == ""
    assert text[7] == "head\n" + half and text[9] == "tail" and text[8] == rows[4][1]
    assert text[1] == text[3] == "" and text[11] == "\n\n\n" and text[21] == rows[-1][1]
    assert text[12] == "same line of words " * 20
    assert set(text[20].split("\n")) == {"x y z"}


def test_windows_share_their_fingerprint():
    rng = random.Random(1)
    lines = [" ".join(f"{rng.random()}" for _ in range(rng.randint(0, 9))) for _ in range(60)]
    run_ = lines[20:40]
    a, b = (list(line_dedup.windows("\n".join(x).encode(), 20)) for x in (lines, ["new one"] * 7 + run_ + ["z"]))
    whole = {w[3]: w[2] for w in a}
    met = [w for w in b if w[3] in whole]
    assert met and all(whole[w[3]] == w[2] for w in met)


def test_empty_table(documents):
    assert line_dedup.dedup(documents([])).count() == 0
