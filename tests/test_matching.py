"""Exclusive matching on random and skewed fixtures.

The result is pinned down by a property, checked for each left row on its own: its
match is what it would choose from the candidates that no earlier row holds. Choices
are stated as filters and sort orders over pandas tables.
"""

import random
from datetime import date, timedelta
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import filenames as fn
from tallyweave.operators import links, matching, reconcile
from tallyweave.operators.matching import greedy_assign
from tallyweave.operators.names import holds
from tallyweave.session import cut
from tallyweave.sources import documents

BASE = date(2024, 1, 10)


def is_serial(order: list, rights: pd.DataFrame, got: dict, choose) -> bool:
    """Every row of ``order`` has what ``choose`` picks among the ``rights`` that earlier rows left over."""
    held = [got[k] for k in order if k in got]
    assert len(held) == len(set(held)) and set(got) <= set(order)
    for n, left in enumerate(order):
        gone = {got[k] for k in order[:n] if k in got}
        want = choose(left, rights[~rights.index.isin(gone)])
        assert got.get(left) == want, (left, got.get(left), want)
    return True


def best(candidates: pd.DataFrame, score: str = "score"):
    """Highest score, then lowest id."""
    return None if candidates.empty else candidates.sort_values(score, ascending=False, kind="stable").index[0]


def reconciled(txs, docs, got) -> bool:
    rights = pd.DataFrame(docs).set_index("id").sort_index()
    rights["doc"] = rights.get("doc")
    left = {t["id"]: t for t in txs}

    def choose(i, free):
        t = left[i]
        near = free[((free.cents.abs() - abs(t["cents"])).abs() <= 2) & ((free.day - t["day"]).abs() <= 3)]
        return best(near.assign(score=(near.doc == t.get("doc")) & near.doc.notna()))

    for k, (r, score) in got.items():
        assert score == (1.0 if left[k].get("doc") and left[k].get("doc") == rights.doc[r] else 0.7)
    return is_serial(sorted(left), rights, {k: v[0] for k, v in got.items()}, choose)


def money(c):
    return Decimal(c).scaleb(-2)


def tx_frames(spark, txs, docs):
    t = spark.createDataFrame(
        [(x["id"], BASE + timedelta(x["day"]), money(x["cents"]), x.get("doc")) for x in txs],
        "tx_id long, tx_date date, amount decimal(18,2), counterparty_doc string")
    f = spark.createDataFrame(
        [(x["id"], BASE + timedelta(x["day"]), None if x["cents"] is None else money(x["cents"]), x.get("doc")) for x in docs],
        "fiscal_id long, issue_date date, total_value decimal(18,2), counterparty_doc string")
    return t, f


def recon(spark, txs, docs):
    got = reconcile.match_invoices(*tx_frames(spark, txs, docs)).collect()
    return {r.tx_id: (r.fiscal_id, r.match_score) for r in got}


def doc(i):
    return str(i).rjust(14, "0")


@pytest.mark.parametrize("seed,cents,days,parties", [(1, 40, 6, 5), (2, 8, 12, 3), (3, 400, 30, 40)])
def test_reconcile_random(spark, seed, cents, days, parties):
    r = random.Random(seed)
    row = lambda i: {"id": i, "cents": 1000 + r.randrange(cents), "day": r.randrange(days), "doc": r.choice([None, doc(r.randrange(1, parties))])}
    ids = r.sample(range(10_000), 240)
    txs, docs = [row(i) for i in ids[:120]], [row(i) for i in sorted(ids[120:])]
    assert reconciled(txs, docs, recon(spark, txs, docs))


def test_reconcile_one_hot_amount(spark):
    """A third of all rows share value and date; they are handed out by rank, in few rounds."""
    r = random.Random(5)
    txs = [{"id": i, "cents": 5000, "day": 3} for i in r.sample(range(100_000), 700)]
    docs = [{"id": i, "cents": 5000, "day": 3} for i in sorted(r.sample(range(100_000), 650))]
    txs += [{"id": 200_000 + i, "cents": 9000 + 10 * i, "day": i % 20} for i in range(300)]
    docs += [{"id": 200_000 + i, "cents": 9001 + 10 * i, "day": i % 20} for i in range(300)]
    left, lists = reconcile.preference_lists(*tx_frames(spark, txs, docs))
    got = {x.left_id: x.right_id for x in greedy_assign(left, lists, max_rounds=3).collect()}
    hot, rest = [t["id"] for t in txs[:700]], range(200_000, 200_300)
    want = dict(zip(sorted(hot), sorted(d["id"] for d in docs[:650]), strict=False)) | {i: i for i in rest}
    assert got == want and len(got) == 950


def test_reconcile_hot_amount_with_tax_ids(spark):
    r = random.Random(6)
    people = list(range(1, 301))
    txs = [{"id": i, "cents": 5000, "day": 3, "doc": doc(p)} for i, p in enumerate(people)]
    r.shuffle(people)
    docs = [{"id": 1000 + i, "cents": 5000, "day": 3, "doc": doc(p)} for i, p in enumerate(people)]
    got = recon(spark, txs, docs)
    assert reconciled(txs, docs, got)
    assert all(s == 1.0 for _, s in got.values())


def test_reconcile_edges(spark):
    one = lambda txs, docs: {k: v[0] for k, v in recon(spark, txs, docs).items()}
    t = lambda i, c=1000, d=0, p=None: {"id": i, "cents": c, "day": d, "doc": p}
    assert one([t(1)], [t(11, 1002)]) == {1: 11}
    assert one([t(1)], [t(11, 1003)]) == {}
    assert one([t(1)], [t(11, 1000, 3)]) == {1: 11}
    assert one([t(1)], [t(11, 1000, 4)]) == {}
    assert one([t(1, -1000)], [t(11, 1000)]) == {1: 11}
    assert one([t(1), t(2)], [t(11)]) == {1: 11}
    assert one([t(1, 1000), t(2, 1002)], [t(11, 1000), t(12, 1004)]) == {1: 11, 2: 12}
    assert one([t(1, 0)], [{"id": 11, "cents": None, "day": 0}]) == {}


def test_result_does_not_depend_on_partitioning(spark):
    r = random.Random(9)
    row = lambda i: {"id": i, "cents": 100 + r.randrange(12), "day": r.randrange(9), "doc": r.choice([None, doc(r.randrange(1, 4))])}
    txs, docs = [row(i) for i in range(60)], [row(i) for i in range(60, 120)]
    t, f = tx_frames(spark, txs, docs)
    a = sorted(reconcile.match_invoices(t.repartition(1), f.repartition(7)).collect())
    b = sorted(reconcile.match_invoices(t.repartition(5, "amount"), f.repartition(2)).collect())
    assert a == b
    assert len({x.tx_id for x in a}) == len(a) == len({x.fiscal_id for x in a})


def plain(name):
    """Letters and digits of a name, without accents."""
    return None if name is None else "".join(c for c in name.translate(str.maketrans("ÇÃ", "CA")) if c.isalnum())


NAMES = ["ANA LIMA", "JOAO SILVA", "LOJA", "LOJA AZUL", "AZUL", "MARIA JOSE", "ÇÃO PAULO", "XYZ"]


@pytest.mark.parametrize("seed,named", [(1, 0.5), (2, 0.2), (3, 0.9)])
def test_receipts_random(spark, seed, named):
    r = random.Random(seed)
    entries = [{"id": i, "cents": 1000 + r.randrange(12), "day": r.randrange(20), "client": r.choice(NAMES + [None, None])} for i in range(90)]
    docs = [{"id": 1000 + i, "cents": 1000 + r.randrange(12), "day": r.randrange(20), "model": r.choice(["55", "65"]),
             "name": r.choice(NAMES) if r.random() < named else None, "pdf": r.random() < 0.4} for i in range(600)]
    e = spark.createDataFrame(
        [(x["id"], x["cents"], x["day"], x["client"], plain(x["client"])) for x in entries],
        "left_id long, cents long, day int, client string, cname string")
    d = spark.createDataFrame(
        [(x["id"], x["cents"], x["day"], x["name"], x["model"], f"p{x['id']}" if x["pdf"] else None, f"x{x['id']}",
          plain(x["name"])) for x in docs],
        "right_id long, cents long, day int, receiver string, doc_model string, pdf_path string, xml_path string, dname string")
    m = links.match_receipts(e, d)
    att = links.receipt_attachments(m, d).where("file_type = 'xml'").collect()
    got = {a.entry_id: (int(a.file_path[1:]), a.match_score) for a in att}
    rights = pd.DataFrame(docs).set_index("id")
    rights["score"] = 0.7 + 0.05 * rights["pdf"]
    left = {x["id"]: x for x in entries}

    def goes(a, b):
        return min(len(a), len(b)) >= 4 and (a in b or b in a)

    def reach(i, free):
        return free[((free.cents - left[i]["cents"]).abs() <= 5) & ((free.day - left[i]["day"]).abs() <= 7)]

    def choose(i, free):
        near, client = reach(i, free), plain(left[i]["client"])
        bare = near["name"].isna()
        if client is None:
            return best(near.assign(score=near.score + 0.05 * (bare & (near.model == "65"))))
        named = near[[x is not None and goes(plain(x), client) for x in near["name"].where(~bare, None)]]
        return best(named) if len(named) else near[bare].index[0] if bare.sum() == 1 else None

    assert is_serial(sorted(left), rights, {k: v[0] for k, v in got.items()}, choose)
    for k, (r, score) in got.items():
        own, d = left[k]["client"], rights.loc[r]
        base = 0.95 if own and isinstance(d["name"], str) else 0.75 if not isinstance(d["name"], str) and d.model == "65" else 0.7
        assert score == round(base + 0.05 * d["pdf"], 2)


def test_receipts_pool(spark):
    """Two nameless invoices and a named payer: no link; one nameless: link."""
    e = spark.createDataFrame([(1, 1000, 0, "ANA LIMA", "ANALIMA")], "left_id long, cents long, day int, client string, cname string")
    schema = "right_id long, cents long, day int, receiver string, doc_model string, pdf_path string, xml_path string, dname string"
    rows = [(11, 1000, 0, None, "55", None, "a", None), (12, 1001, 1, None, "55", None, "b", None)]
    assert links.match_receipts(e, spark.createDataFrame(rows, schema)).count() == 0
    assert links.match_receipts(e, spark.createDataFrame(rows[:1], schema)).count() == 1


def test_receipts_later_passes_touch_changed_groups_only(spark):
    """A payer without a name leaves one of two nameless invoices; only its group is matched again."""
    e_schema = "left_id long, cents long, day int, client string, cname string"
    d_schema = "right_id long, cents long, day int, receiver string, doc_model string, pdf_path string, xml_path string, dname string"
    entries = [(1, 1000, 0, None, None), (2, 1000, 0, "ANA LIMA", "ANALIMA"), (3, 1003, 2, "LOJA AZUL", "LOJAAZUL")]
    docs = [(11, 1000, 0, None, "55", None, "a", None), (12, 1001, 1, None, "55", None, "b", None), (13, 1004, 3, None, "55", None, "c", None), (14, 1008, 9, None, "55", None, "d", None)]
    entries += [(100 + i, 5000 + 20 * i, i % 9, "XYZW", "XYZW") for i in range(40)]
    docs += [(1000 + i, 5000 + 20 * i, i % 9, "XYZW" if i % 2 else None, "55", None, "x", "XYZW" if i % 2 else None) for i in range(40)]
    trace = []
    got = {r.left_id: r.right_id for r in links.match_receipts(spark.createDataFrame(entries, e_schema), spark.createDataFrame(docs, d_schema), trace).collect()}
    # payer 1 takes 11; 12 and 13 are left for payer 2, so none; payer 3 too
    assert {k: v for k, v in got.items() if k < 100} == {1: 11} and all(got[100 + i] == 1000 + i for i in range(40)) and trace == [43]
    trace = []
    got = {r.left_id: r.right_id for r in links.match_receipts(
        spark.createDataFrame(entries, e_schema), spark.createDataFrame([d for d in docs if d[0] != 13], d_schema), trace).collect()}
    # now payer 2 finds 12 alone, which leaves 14 to payer 3: one more choice in each pass
    assert {k: v for k, v in got.items() if k < 100} == {1: 11, 2: 12, 3: 14} and len(got) == 43
    assert trace[0] == 43 and len(trace) > 1 and all(n <= 3 for n in trace[1:])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_files_random(spark, seed):
    r = random.Random(seed)
    people = ["ANA LIMA", "JOAO SILVA", "BDFGKL LTDA", "BDFGKL SA", "AZUL"]
    day = lambda: r.randrange(14)
    shown = lambda d, form: (BASE + timedelta(d)).strftime(form)
    entries, files = [], []
    for i in range(60):
        entries.append({"id": i, "cents": 1000 + r.randrange(25), "day": day(), "cp": r.choice([*people, None]), "bank": r.choice(["a", "b"]),
                        "desc": r.choice(["PIX ENVIADO", "BOLETO ANA LIMA", "DIVERSOS"])})
    for i in range(55):
        d, c, who, kind = day(), 1000 + r.randrange(25), r.choice(people), r.randrange(4)
        amount = f"{c // 100},{c % 100:02d}"
        f = {"id": 500 + i, "bank": r.choice(["a", "b", None]), "cents": None, "slip_day": None, "iso": None, "who": None}
        if kind == 0:
            f |= {"name": f"{i} - {shown(d, '%d%m%Y')} - Pagamento - {amount}.pdf", "cents": c, "slip_day": d}
        elif kind == 1:
            f |= {"name": f"{i} - {shown(d + 9, '%d%m%Y')} - {who} - {amount}.pdf", "cents": c, "slip_day": d + 9}
        elif kind == 2:
            f |= {"name": f"PIX{i}_{shown(d, '%Y-%m-%d')}_{who}.pdf", "iso": d, "who": plain(who)}
        else:
            f |= {"name": f"{who} recibo {i}.pdf"}
        files.append(f)
    led = spark.createDataFrame(
        [(e["id"], BASE + timedelta(e["day"]), e["desc"], e["cp"], e["bank"], money(e["cents"])) for e in entries],
        "entry_id long, entry_date date, description string, counterparty string, bank_account_id string, amount decimal(18,2)")
    fl = spark.createDataFrame(
        [(f["id"], "COMPROVANTES/" + f["name"], f["name"], f["bank"], 10) for f in files],
        "file_id long, path string, file_name string, bank_account_id string, size long",
    ).withColumn("kind", F.lit("comprovante")).withColumn("ext", F.lit(".pdf"))
    names = {f["name"]: f["id"] for f in files}
    got = {a.entry_id: (names[a.file_path.split("/")[1]], round(a.match_score, 2)) for a in links.file_attachments(led, fl).collect()}
    rights, left, scores = pd.DataFrame(files).set_index("id"), {e["id"]: e for e in entries}, {}
    rights["plain"] = rights["name"].map(plain).str.upper()

    def goes(a, b):
        return bool(a) and bool(b) and (a in b or b in a or a[:6] == b[:6])

    def choose(i, free):
        e = left[i]
        value = (free.cents - e["cents"]).abs() <= 5
        away = (free.slip_day - e["day"]).abs()
        dated = (free.iso - e["day"]).abs() <= 2
        payer = [goes(w, plain(e["cp"] or e["desc"])) for w in free.who.where(free.who.notna(), None)]
        named = [goes(n, plain(e["cp"])) or goes(n, plain(e["desc"])) for n in free.plain]
        s = pd.Series(0.0, free.index).mask(pd.Series(named, free.index) & value, 0.8).mask(pd.Series(payer, free.index) & dated, 0.75)
        s = s.mask(value & (away <= 2), 0.9).mask(value & (away == 0), 1.0)
        s = (s + 0.05 * (free.bank == e["bank"])).round(2)
        scores[i] = s
        return best(free.assign(score=s)[s > 0.5])

    assert is_serial(sorted(left), rights, {k: v[0] for k, v in got.items()}, choose) and len(got) > 15
    assert all(scores[k][f] == s for k, (f, s) in got.items())


@pytest.mark.parametrize("seed,days,n,m", [(1, 8, 20, 30), (2, 30, 25, 25), (3, 12, 40, 20), (4, 40, 20, 34)])
def test_fuel_random(spark, seed, days, n, m):
    r = random.Random(seed)
    minute = lambda: r.choice([None, r.randrange(1440)])
    docs = [{"id": i, "day": r.choice([None] + list(range(days)) * 2), "minute": minute()} for i in range(m)]
    entries = [{"id": 1000 + i, "day": r.randrange(days), "minute": minute()} for i in range(n)]
    d = spark.createDataFrame(
        [(x["id"], None if x["day"] is None else BASE + timedelta(x["day"]), None if x["minute"] is None else f"{x['minute'] // 60:02d}:{x['minute'] % 60:02d}") for x in docs],
        "doc_id long, doc_date date, doc_time string")
    epoch = (BASE - date(1970, 1, 1)).days
    e = spark.createDataFrame([(x["id"], epoch + x["day"], x["minute"]) for x in entries], "entry_id long, day int, minute int")
    got = {x.doc_id: (x.entry_id, x.score) for x in links.match_fuel(d, e).collect()}
    rights, left, scores = pd.DataFrame(entries).set_index("id"), {x["id"]: x for x in docs}, {}
    rights["minute"] = rights["minute"].astype(float)

    def choose(i, free):
        doc = left[i]
        if doc["day"] is None:
            return None
        here, beside = free[free.day == doc["day"]], free[(free.day - doc["day"]).abs() == 1]
        gap = (here.minute - (float("nan") if doc["minute"] is None else doc["minute"])).abs()
        graded = pd.Series(0.7, here.index).mask(gap <= 120, 0.85).mask(gap <= 30, 0.98)
        if len(here) == 1:
            graded[:] = 0.95
        elif here.empty and len(beside) == 1:
            here, graded = beside, pd.Series(0.6, beside.index)
        scores[i] = graded
        return best(here.assign(score=graded)) if len(graded) else None

    order = sorted(left, key=lambda i: (left[i]["day"] is not None, left[i]["day"] or 0, i))
    assert is_serial(order, rights, {k: v[0] for k, v in got.items()}, choose)
    assert all(scores[k][x] == s for k, (x, s) in got.items())


def test_fuel_scores(spark):
    """One entry on the day; two with gaps of 20 and 90 minutes; none and one the next day."""
    schema = "doc_id long, doc_date date, doc_time string"
    epoch = (BASE - date(1970, 1, 1)).days
    run = lambda docs, entries: {
        x.doc_id: (x.entry_id, x.score)
        for x in links.match_fuel(spark.createDataFrame(docs, schema), spark.createDataFrame(entries, "entry_id long, day int, minute int")).collect()
    }
    assert run([(1, BASE, "10:00")], [(9, epoch, 60)]) == {1: (9, 0.95)}
    assert run([(1, BASE, "10:00")], [(8, epoch, 690), (9, epoch, 620)]) == {1: (9, 0.98)}
    assert run([(1, BASE, "10:00")], [(9, epoch + 1, 600)]) == {1: (9, 0.6)}


def test_fuel_names(spark):
    rows = [("Scan_20260624_144751.jpg",), ("Digitalizado_20260616-1520.pdf",), ("x 09062026.pdf",), ("x 062026.pdf",), ("x.pdf",), ("thumbs.db",)]
    df = spark.createDataFrame([(n, date(2026, 6, 20)) for (n,) in rows], "file_name string, modified date")
    got = {r.file_name: (str(r.doc_date), r.doc_time) for r in documents.fuel_receipts(df).collect()}
    assert got == {
        "Scan_20260624_144751.jpg": ("2026-06-24", "14:47"), "Digitalizado_20260616-1520.pdf": ("2026-06-16", "15:20"),
        "x 09062026.pdf": ("2026-06-09", None), "x 062026.pdf": ("2026-06-20", None), "x.pdf": ("2026-06-20", None)}
    assert fn.FUEL_EXTENSIONS


def test_first_file_with_a_name_that_a_third_holds(spark, monkeypatch):
    """The smallest id among all files that hold a name, or whose name it holds, however many they are."""
    from tallyweave.operators import names

    r = random.Random(8)
    word = lambda n: "".join(r.choice("ABCD") for _ in range(n))
    files = [(i, ("LOJAAZUL" if i % 3 == 0 else "") + word(r.randrange(1, 9)) + ("X" if i > 500 else "")) for i in r.sample(range(5, 3000), 900)]
    asked = ["LOJAAZUL", "JAAZ", "AZULX", "AB", "A", "ABCDX", "LOJAAZULA", "NOTTHERE", "ZZ", "DCBAX", "", "LOJAAZULDD"] + [word(k) for k in (3, 4, 5, 6, 7, 12)]
    df = spark.createDataFrame(files, "file_id long, file_name string").withColumn("path", F.lit("p"))
    q = spark.createDataFrame([(a,) for a in [*asked, "LOJAAZUL"]], "name string")
    got = {x.name: x.file_id for x in links.first_named_file(q, "name", df).collect()}
    want = {a: min((i for i, f in files if a in f or f in a), default=None) for a in asked if a}
    assert got == {a: i for a, i in want.items() if i is not None}
    few = [(f, min(i for i, g in files if g == f)) for f in {f for _, f in files}]
    by = names.first_holding(q, "name", spark.createDataFrame(few, "f string, file_id long"), "f", "file_id", first=2)
    assert {x.name: x.file_id for x in by.collect()} == {a: m for a in asked if a for m in [min((i for i, f in files if a in f), default=None)] if m is not None}


# --- joins on multiplied rows ------------------------------------------------

def broadcasts_generated(df) -> bool:
    """Whether the plan sends rows made by a generator to driver and executors."""
    plan = df._jdf.queryExecution().sparkPlan()

    def walk(node, below: bool) -> bool:
        name = node.nodeName()
        if below and name.startswith("Generate"):
            return True
        built = name.startswith("BroadcastHashJoin") or name.startswith("BroadcastNestedLoopJoin")
        right = built and "BuildRight" in str(node.buildSide())
        kids = node.children()
        return any(walk(kids.apply(i), below or (built and (i == 1) == right)) for i in range(kids.size()))

    return walk(plan, False)


def test_spread_rows_are_not_broadcast(spark):
    right = cut(spark.createDataFrame([(7, 1000, 5, "a"), (8, 1002, 9, "a"), (9, 2000, 5, None)], "right_id long, cents long, day int, doc string"))
    cells = spark.createDataFrame([(1001, 6, "a"), (2000, 30, "b")], "cents long, day int, doc string")
    near = reconcile.cell_lists(cells.drop("doc"), right.drop("doc"), 2, 3)
    by_doc = reconcile.cell_lists_by_doc(cells, right, 2, 3)
    assert not broadcasts_generated(near) and not broadcasts_generated(by_doc)
    assert {r.right_id for r in near.collect()} == {7, 8} == {r.right_id for r in by_doc.collect()}


def test_pieces_and_name_keys_are_not_broadcast(spark):
    files = cut(spark.createDataFrame([(1, "PADARIASOL"), (2, "SOL"), (3, "LUA")], "file_id long, x string"))
    names = cut(spark.createDataFrame([("PADARIASOLNOVO",), ("PADARIA",), ("ASOLB",)], "n string"))
    inside = holds(names, "n", files.select("x"), "x")
    assert not broadcasts_generated(inside)
    assert {tuple(r) for r in inside.collect()} == {("PADARIASOLNOVO", "PADARIASOL"), ("PADARIASOLNOVO", "SOL"), ("ASOLB", "SOL")}
    entries = spark.createDataFrame(
        [(1, 1000, 5, "b1", "PADARIASOL", ["PADARIASOL"]), (2, 900, 50, None, "", [])],
        "left_id long, cents long, day int, bank string, who string, names array<string>")
    slips = spark.createDataFrame(
        [(10, "b1", 1003, 80, None, "", "1PADARIASOL"), (11, "b2", None, None, 6, "PADARIASOL", "PIXPADARIASOL"), (12, "b1", 1003, 90, 40, "", "2PADARIASOL")],
        "right_id long, bank string, cents long, day int, iso int, iname string, fname string")
    left_lists, lists = links.file_lists(entries, slips)
    assert not broadcasts_generated(lists)
    found = left_lists.join(lists, "list_id").groupBy("left_id", "right_id").agg(F.min("tier").alias("tier"))
    assert {tuple(r) for r in found.collect()} == {(1, 10, 4), (1, 11, 6), (1, 12, 4)}


def test_used_up_windows_double(spark, monkeypatch):
    """Lists of their own over the same entries: who comes late looks at most of a list before it finds a free entry."""
    monkeypatch.setattr(matching, "SPARE", 4)
    n, trace = 60, []
    lefts = spark.range(1, n + 1).select(F.col("id").alias("left_id"), F.lit(0).alias("tier"), F.concat(F.lit("l"), F.col("id")).alias("list_id"))
    lists = lefts.select("list_id").crossJoin(spark.range(1, n + 1).withColumnRenamed("id", "right_id"))
    got = {r.left_id: r.right_id for r in greedy_assign(lefts, lists, max_rounds=40, trace=trace).collect()}
    assert got == {i: i for i in range(1, n + 1)}
    assert len(trace) <= 7, trace


def test_crowded_places_are_cut_in_id_order(spark):
    """The chunks of a place get right one after the other, half a chunk in each round at least."""
    n, trace = 240, []
    lefts = spark.range(1, n + 1).select(
        F.col("id").alias("left_id"), F.lit("7").alias("place"), F.lit(0).alias("tier"), F.concat(F.lit("l"), F.col("id")).alias("list_id"))
    lists = lefts.select("list_id").crossJoin(spark.range(1, n + 1).withColumnRenamed("id", "right_id"))
    got = {r.left_id: r.right_id for r in greedy_assign(lefts, lists, max_rounds=9, chunk=60, trace=trace, spare=n).collect()}
    assert got == {i: i for i in range(1, n + 1)} and len(trace) <= 8, trace


def test_chunks_hold_whole_places_in_order(spark):
    lefts = spark.createDataFrame(
        [(i, p, 0, "l") for i, p in enumerate(["10", "9", "9", None, "101", "x", "10", "9", "7", "7", "7", "7", "7", "7", "7"])], "left_id long, place string, tier int, list_id string")
    chunks = {r.left_id: r.at // 4 for r in matching._positions(lefts, 4).collect()}
    at = {}
    for r in lefts.collect():
        at.setdefault(r.place, []).append(chunks[r.left_id])
    assert len(chunks) == 15 and all(len(set(at[p])) == 1 for p in ("10", "9", "101", "x", None))
    assert at["7"] == sorted(at["7"]) and len(set(at["7"])) > 1  # cut in id order
    assert max(at["7"]) <= at["9"][0] <= at["10"][0] <= at["101"][0] and max(list(chunks.values()).count(c) for c in chunks.values()) < 8


def test_fuel_entries_are_on_few_lists(spark):
    """Blocks of minutes: ten lists an entry, none for each minute in reach."""
    r = random.Random(3)
    docs = [(i, r.randrange(3), r.choice([None, 0, 29, 30, 31, 120, 121, 1439, 6039] + [r.randrange(1440) for _ in range(9)])) for i in range(600)]
    entries = [(1000 + i, r.randrange(3), r.choice([None, 0, 1, 59, 60, 61, 1410, 1439, 5920, r.randrange(1440), r.randrange(1440), r.randrange(1440)])) for i in range(60)]
    left, lists = links.fuel_minute_lists(spark.createDataFrame(docs, "doc_id long, day int, minute int"), spark.createDataFrame(entries, "entry_id long, day int, minute int"))
    assert lists.count() <= 10 * len(entries) and left.count() <= 32 * len(docs)
    assert left.count() == left.distinct().count() and lists.count() == lists.distinct().count()
    got = left.join(lists, "list_id").groupBy("left_id", "right_id").agg(F.min("tier")).collect()
    tier = lambda a, b: 2 if a is None or b is None or abs(a - b) > 120 else 1 if abs(a - b) > 30 else 0
    assert {tuple(x) for x in got} == {(i, j, tier(a, b)) for i, d, a in docs for j, e, b in entries if d == e}


def test_copies_and_keys_are_few(spark):
    """Four copies of a row in reach of a window, and no list keys for entries without a file in their cell."""
    right = spark.createDataFrame([(i, 1000 + i, i) for i in range(60)], "right_id long, cents long, day int")
    cells = spark.createDataFrame([(990 + i, d) for i in range(80) for d in range(0, 70, 3)], "cents long, day int")
    assert reconcile.near_copies(right, 5, 2).count() <= 4 * 60
    got = {(r.cents, r.day, r.right_id) for r in reconcile.cell_lists(cells, right, 5, 2).collect()}
    assert got == {(c, d, i) for c in range(990, 1070) for d in range(0, 70, 3) for i in range(60) if abs(c - 1000 - i) <= 5 and abs(d - i) <= 2}
    entries = spark.createDataFrame(
        [(i, 1000 + 100 * i, i, "b", f"PAYER{i:03}", [f"PAYER{i:03}", "PIX"]) for i in range(50)],
        "left_id long, cents long, day int, bank string, who string, names array<string>")
    slips = spark.createDataFrame([(90, "b", 1003, 0, None, "", "SLIP"), (91, "b", None, None, 7, "PAYER007", "PIX")], "right_id long, bank string, cents long, day int, iso int, iname string, fname string")
    left_lists, lists = links.file_lists(entries, slips)
    assert left_lists.count() <= 30
    found = left_lists.join(lists, "list_id").groupBy("left_id", "right_id").agg(F.min("tier")).collect()
    assert {tuple(r) for r in found} == {(0, 90, 0)} | {(i, 91, 5) for i in (5, 6, 7, 8, 9)}


def test_names_without_known_ends_leave_early(spark):
    from tallyweave.operators.names import with_known_ends

    known = spark.createDataFrame([("ALFA",), ("LFAC",), ("FACO",)], "g string")
    held = spark.createDataFrame([("ALFACO",), ("ALFA",), ("ALFAX",), ("XLFACO",)], "x string")
    assert {r.x for r in with_known_ends(held, "x", known).collect()} == {"ALFACO", "ALFA"}


def test_rows_that_repeat_count_once(spark):
    lefts = spark.createDataFrame([(i, 0, "a") for i in range(4)] + [(i, 1, "b") for i in range(4)], "left_id long, tier int, list_id string")
    lists = spark.createDataFrame([("a", 5), ("a", 7), ("b", 5), ("b", 8), ("b", 9)], "list_id string, right_id long")
    want = {0: 5, 1: 7, 2: 8, 3: 9}
    for left, right in ((lefts, lists), (lefts, lists.unionByName(lists)), (lefts.unionByName(lefts), lists), (lefts.unionByName(lefts), lists.unionByName(lists))):
        assert {r.left_id: r.right_id for r in greedy_assign(left, right, max_rounds=6).collect()} == want
