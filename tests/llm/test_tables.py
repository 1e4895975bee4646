"""Queries against their SQL twins on tables with nulls, ties, repeated rows, long and empty texts and clashing column names."""

import random

import duckdb
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyweave.llm.registry import ORACLES, QUERIES

VOCABULARY = [a + b + c for a in ("th", "er", "on", "qu") for b in ("a", "e", "io", "ü") for c in ("nd", "st", "s,", "x.")]
# Names that the operators use themselves.
EXTRA = ["_id", "_h", "_row", "_part", "_doc", "size", "key", "line", "pos", "words", "sig", "rank", "first", "n", "first__id"]


def prose(draw: random.Random, n: int) -> str:
    words = [draw.choice(VOCABULARY) for _ in range(n)]
    return "".join(w + (draw.choice((" ", " ", " ", "\n", "  ", "\t")) if i % 7 == 6 else " ") for i, w in enumerate(words)).strip()


def documents() -> list[tuple]:
    draw = random.Random(5)
    base = [prose(draw, 40 + 10 * i) for i in range(20)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for i in range(6):  # near copies, and copies of them
        words = base[i].split(" ")
        words[len(words) // 2] = "Changed"
        rows.append((100 + i, " ".join(words), "s0"))
    rows += [(200 + i, base[9], "s1") for i in range(5)]
    rows += [(300 + i, prose(draw, 30) + "\n  Subscribe to our NEWSLETTER now \n" + prose(draw, 12 if i % 2 else 1), "hot") for i in range(30)]
    rows += [(400 + i, "Subscribe to our newsletter now\n" * 6 + str(i) + " more", "hot") for i in range(25)]
    rows += [
        (500, None, "s0"), (501, "", "s0"), (502, " \n\t\n ", None), (None, base[3] + " tail", None), (None, base[4], "s2"), (503, base[5], "s2"), (503, base[5], "s2"),
        (503, base[6] + "\n" + base[7], "s2"), (504, "one two", "s1"), (505, "word " * 4000, "s1"), (506, "x" * 30_000 + "\n" + "Ünï cödé 𝒳 line\n" * 3, "s1"),
        (507, "#a $b %c &d |e <f> *g\n#a $b %c &d |e <f> *g\n\n", ""), (-8, base[8].upper(), "s1"), (509, "a b c d e f a b c d e f a b c d e", "s2"),
        (510, "carriage\r\nreturns and\x0bother\x0cblanks " * 9, "s2"),
    ]
    return rows


def benchmark() -> list[tuple]:
    draw = random.Random(5)
    base = [prose(draw, 40 + 10 * i) for i in range(20)]
    return [
        (1, " ".join(base[2].split()[5:30])), (2, base[3]), (2, base[3]), (3, "One TWO"), (4, None), (5, ""), (6, "?! ..."), (None, " ".join(base[6].split()[:13])),
        (7, "nowhere to be found at all in any of the texts that are here"), (10, "word " * 20)]


def pages() -> list[tuple]:
    html = ["<p>one</p>", "<p>two ü</p>", "", "<b>three</b>" * 500]
    urls = ["http://a.example.com/x", "https://b.c.example.org:80/?q#f", "https://u@Deep.Sub.Host.example.net./p", "ftp://no.host/", "nonsense", None]
    return [(i, urls[i % 6], html[i % 4] if i % 5 else html[1]) for i in range(40)] + [(40, urls[0], "<p>alone</p>"), (41, None, None), (42, urls[2], "line\r\n\r\nbreaks\x00")]


def labels() -> list[tuple]:
    draw = random.Random(6)
    return [(r[0], draw.choice((0, 1, 1, None)), draw.randrange(2)) for r in documents() if r[0] != 505] + [(9999, 1, 0)]


def embeddings() -> list[tuple]:
    draw = random.Random(8)
    middles = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + draw.gauss(0, 0.5) for x in middles[i % 4]], draw.randrange(10)) for i in range(300)]
    return [*rows, (350, None, 1), (400, [1.0] * 6, None), (450, [float("nan")] * 6, 2), (500, [None, *[1.0] * 5], 3), (550, [float("inf"), *[0.0] * 5], 4), (600, rows[50][1], 5), (601, rows[50][1], 6)]


def write(folder, name: str, columns: dict, rows: list[tuple], extra: bool) -> None:
    data = {c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(columns.items())}
    if extra:
        data |= {c: pa.array(range(len(rows)), pa.int64()) for c in EXTRA}
    pq.write_table(pa.table(data), f"{folder}/{name}.parquet")


def tables(folder, extra: bool, empty: bool = False):
    cut = slice(0, 0) if empty else slice(None)
    write(folder, "documents", {"doc_id": pa.int64(), "text": pa.string(), "source": pa.string()}, documents()[cut], extra)
    write(folder, "benchmark", {"item_id": pa.int64(), "text": pa.string()}, benchmark()[cut], extra)
    write(folder, "pages", {"page_id": pa.int64(), "url": pa.string(), "html": pa.string()}, pages()[cut], extra)
    write(folder, "labels", {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()}, labels()[cut], extra)
    write(folder, "embeddings", {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32()}, embeddings()[cut], extra)
    return str(folder)


def connect(folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def full(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("full"), extra=True)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), extra=False, empty=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, full, name):
    ok, note = oracle.compare(spark, connect(full), full, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.count() == 0 and len(df.columns) >= 3


def test_near_copies_are_one_class(spark, full):
    found = {r.doc_id: r.class_id for r in QUERIES["op8_probminhash"](spark, full).collect() if r.doc_id is not None}
    assert all(found[100 + i] == i for i in range(2, 6)) and all(found[200 + i] == 9 for i in range(5)) and found[10] == 10
