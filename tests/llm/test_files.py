"""Token shards and ZIP packages: formats, exact round trips, brute force."""

import io
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_tables import documents, tables

from tallyweave.llm import token_files as tf, warc_zip as wz
from tallyweave.llm.registry import QUERIES, TOKENIZER


@pytest.fixture(scope="module")
def full(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("files"), extra=True)


def test_elias_fano():
    draw = random.Random(1)
    for n, step in ((0, 1), (1, 0), (1, 10**12), (5, 0), (3000, 3), (9000, 1), (2000, 10**9)):
        values = np.cumsum([draw.randrange(step + 1) for _ in range(n)]).astype(np.int64)
        ef = tf.EliasFano.frombytes(tf.EliasFano.of(values).tobytes())
        assert (ef.values(0, n) == values).all()
        for _ in range(30 if n else 0):
            a, b = sorted((draw.randrange(n), draw.randrange(n + 1)))
            assert ef.select(a) == values[a] and (ef.values(a, b) == values[a:b]).all()
    dense = tf.EliasFano.of(np.cumsum([300] * 10_000))
    assert len(dense.tobytes()) * 8 < 10_000 * 11


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_pieces_encode_as_the_library_does():
    t, e = library(), tf.Encoder(TOKENIZER)
    draw = random.Random(2)
    alphabet = ["a", "th", " ", " ", "  ", "\n", "\t", "é", " ", "1", "'s", "!", "<|endoftext|>", "𝒳", " ", "\x1c", "\x85", "Don't", "²", "_", "ª", "½x", "ŉ", "ǅ", "ß", "\r\n", "\x0b", "·", "÷", "\xad", "ʹ", "٣", "9"]
    for _ in range(6000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 14)))
        want = np.array([*t.encode(text, add_special_tokens=False).ids, 0], e.kind).tobytes()
        assert e.encode(text) == want, repr(text)
    assert e.encode(None) == e.encode("") == np.array([0], e.kind).tobytes()


def brute(rows):
    t, start, out = library(), 0, []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, full):
    got = [tuple(r) for r in QUERIES["op7_elias_fano"](spark, full).collect()]
    got.sort(key=lambda r: r[1])
    kind = tf.Encoder(TOKENIZER)
    rows = sorted(((r[0], r[1]) for r in documents()), key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32(kind.encode(r[1]))))
    assert got == brute(rows)


def test_zip_directory_forms(monkeypatch):
    for limit in (None, 10):
        if limit:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.comment = b"PK\5\6 not the end" * 3
            z.writestr("one.txt", b"first member")
            z.writestr(zipfile.ZipInfo("zwei-ü.txt"), b"second member, longer")
            z.writestr("packed", b"z" * 1000, zipfile.ZIP_DEFLATED)
        data = buffer.getvalue()
        assert (b"PK\6\6" in data) == bool(limit)
        found = wz.directory(lambda n, at: data[at:at + n], len(data))  # noqa: B023
        assert {k: data[a:a + n] for k, (a, n) in found.items()} == {"one.txt": b"first member", "zwei-ü.txt": b"second member, longer"}
    with pytest.raises(ValueError):
        wz.directory(lambda n, at: bytes(n), 100)


def test_ranges_cover_records(tmp_path):
    path = tmp_path / "p.zip"
    with pa.OSFile(str(path), "wb") as out:
        package = wz.Package(out)
        for i in range(50):
            package.add(i, wz.record(i, f"http://h/{i}\r\nX: y", b"payload %d" % i * i, None if i % 3 else (7,)))
        package.close()
    with pa.OSFile(str(path), "rb") as f:
        size = path.stat().st_size
        found = []
        for at, lengths in wz.ranges(f.read_at, size, limit=1500):
            data = f.read_at(sum(lengths), at)
            assert len(lengths) == 1 or sum(lengths) <= 1500
            for n in lengths:
                found.append(wz.parse(data[:n]))
                data = data[n:]
    assert [r["page_id"] for r in found] == list(range(50))
    assert all(r["refers_to"] == (None if i % 3 else 7) and r["payload_bytes"] == len(b"payload %d" % i * i) for i, r in enumerate(found))
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())


def test_damage_is_found():
    good = zlib.decompress(wz.record(1, "u", b"payload", None), 31)
    with pytest.raises(ValueError):
        wz.parse(zlib.compress(good.replace(b"payload\r", b"pAyload\r"), wbits=31))


def test_packages_with_nulls_and_repeats(spark, tmp_path):
    rows = [(None, None, "same"), (3, "u", "same"), (3, "v", "same"), (5, "u", "same"), (None, "w", None), (None, "w", "only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.url or "", r.payload_bytes, r.record_type, r.refers_to) for r in wz.archived(df, str(tmp_path / "out")).collect())
    assert got == [
        ("3", "u", 4, "response", None), ("3", "v", 4, "response", None), ("5", "u", 4, "revisit", 3),
        ("None", "", 4, "revisit", 3), ("None", "w", 0, "response", None), ("None", "w", 4, "response", None)]
    least = wz.archived(df, str(tmp_path / "two"), least=5).collect()
    assert all(r.record_type == "response" for r in least) and len(least) == 6


def test_texts_are_encoded_and_placed_in_one_pass(spark, monkeypatch):
    """Every Python pass that feeds another keeps a worker of its own in each running task."""
    plans = []

    def cut(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, label)

    plain = tf.cut
    monkeypatch.setattr(tf, "cut", cut)
    rows = [(i * 5 % 101 if i % 9 else None, "word " * (i % 7)) for i in range(101)]
    got = tf.token_files(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    assert len(plans) == 1 and plans[0].count("MapInArrow") == 2  # encode and place, write
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None)
    assert [r.start for r in sorted(got, key=lambda r: r.start)][0] == 0 and len(got) == len(rows)


def test_many_texts_are_encoded_at_once_by_distinct_runs(monkeypatch):
    """Memory that is far too small, and texts of all kinds side by side, change no id; Python sees each distinct run once a call."""
    seen, learned = [], []
    ids_of, learn = tf.Encoder._ids, tf.Encoder._learn
    monkeypatch.setattr(tf, "MEMORY", 40)
    monkeypatch.setattr(tf.Encoder, "_ids", lambda self, runs: (seen.append(list(runs)), ids_of(self, runs))[1])
    monkeypatch.setattr(tf.Encoder, "_learn", lambda self, new: (learned.extend(new), learn(self, new))[1])
    t, e = library(), tf.Encoder(TOKENIZER)
    draw = random.Random(7)
    alphabet = [*"'slverdt!aZ1_9 ", " ", "  ", "\n", "\xa0", "é", "ɏ", "'ll", "'ve", "a's", "ß's", "1's", "ɐ", "\x1e", "²"]
    texts = [None if i % 50 == 7 else "".join(draw.choice(alphabet) for _ in range(draw.randrange(12))) for i in range(4000)]
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], e.kind).tobytes() for x in texts]
    assert [ids for i in range(0, len(texts), 300) for ids in e.encode_all(texts[i:i + 300])] == want and e.encode_all([]) == []
    assert all(len(runs) == len(set(runs)) for runs in seen)
    e, many = tf.Encoder(TOKENIZER), ["over and over, it's 1 word " * 2000, "over again"]
    seen.clear(), learned.clear()
    for _ in range(3):
        assert e.encode_all(many)[0] == np.array([*t.encode(many[0], add_special_tokens=False).ids, 0], e.kind).tobytes()
    assert len(seen) == 3 and len(seen[0]) < 15 and len(learned) == len(seen[0]) - 1  # all but the stop, once
    rare = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(200)]
    for i in range(0, 200, 10):  # what every call meets outlasts what is met once
        e.encode_all([many[0] + " ".join(rare[i:i + 10])])
    assert max(map(learned.count, seen[0])) == 1 and len(e.recent) + len(e.older) <= tf.MEMORY + 30
