"""Fill-in-middle, document fingerprints and filter audits against plain loops, exact round trips and odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F
from same import assert_same
from test_text_operators import ODD, docs

from tessera.llm import fill_in_middle as fim, filter_audit, fingerprints as fp
from tessera.llm.queries import ORACLE_SQL, QUERIES

MORE = [*ODD, (30, " \t\n"), (31, "<P> stays"), (32, "a <" + "S> b " * 40), (33, "x\x1fy z w v"), (34, "é\U0001f600 " * 700 + "  "), (35, "one"), (36, "  led by blanks"), (None, "no id at all"), (37, "<<SS>> <P " * 30)]


def units(text):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("every", [1, 2, 3, 256])
def test_checkpoints_cut_anywhere(every):
    rng = random.Random(every)
    for _ in range(60):
        text = "".join(rng.choice(["a", "é", "\U0001f600", " ", "\n", "\t", "bc", "\x0b"]) for _ in range(rng.randrange(0, 60)))
        index, parts = fim.Checkpoints(text.encode(), every), units(text)
        assert index.n == len(parts) and len(index.bytes) == len(index.points) <= len(parts) // every + 1
        starts = [(k, len("".join(parts[:k])), len("".join(parts[:k]).encode())) for k in range(len(parts) + 1)]
        for k, points, size in starts:
            assert index.cut(units=k) == fim.Place(k, points, size)
        for most in range(len(text) + 2):
            assert index.cut(points=most).points == max(p for _, p, _ in starts if p <= most)
        for most in range(len(text.encode()) + 2):
            assert index.cut(bytes=most).bytes == max(s for _, _, s in starts if s <= most)


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    u = units(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_cuts_by_plain_loop(spark):
    rows = [*MORE, *((100 + i, " ".join(random.Random(i).choice(["<", "S>", "<M", "word", ">"]) for _ in range(i))) for i in range(200))]
    found = fim.filled(docs(spark, rows).repartition(3)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found))) == sorted(map(str, ((i, *plain_fim(i, t)) for i, t in rows)))
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.filled(docs(spark, [])).count() == 0


def xx(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_sketch(text, k=5, scale=8):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    hashes = set() if not w else {xx(" ".join(w))} if len(w) < k else {xx(*w[i : i + k]) for i in range(len(w) - k + 1)}
    low = {h for h in hashes if h < -(1 << 63) + (1 << 64) // scale}
    return low or ({min(hashes)} if hashes else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0], r[1].encode()))
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edit = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b = plain_sketch(text), plain_sketch(edit)
        yield i, text, edit, sorted(a), sorted(b), round(jaccard(a, b), 9), round(jaccard(a, plain_sketch(after)), 9)


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_fingerprints_by_plain_loop(spark, monkeypatch, share):
    monkeypatch.setattr(fp, "RANGE_ROWS", share)
    monkeypatch.setattr(fp.with_next, "__defaults__", (share,))
    words = [f"w{k}" for k in range(300)]
    rows = [*MORE, (5_000_000_000, "far off"), (-7, "below nought"), (9, "one id"), (9, "two texts"), (9, "one id"), *((1000 + i * i, " ".join(random.Random(i % 30).choices(words, k=i * 3))) for i in range(60))]
    rows = [(i, t) for i, t in rows if t is None or len(t) < 50_000]
    found = fp.edited(docs(spark, rows).repartition(5)).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.edited, list(r.sketch), list(r.edited_sketch), round(r.near_edited, 9), round(r.near_next, 9)) for r in found))) == sorted(map(str, plain_edits(rows)))


def test_fingerprints_of_odd_tables(spark):
    assert fp.edited(docs(spark, [])).count() == 0
    one = fp.edited(docs(spark, [(3, "a b c d")])).first()
    assert (one.edited, one.near_next) == ("a b a b"[:4] + "a b", 1.0)
    none = fp.edited(docs(spark, [(None, "b"), (None, None), (None, "a")])).collect()
    assert sorted((r.text, r.edited) for r in none) == [("", ""), ("a", "a"), ("b", "b")]
    same = fp.fingerprints(docs(spark, [(1, "x y " * 500), (2, "x y " * 500), (3, "X y " * 500)])).select(fp.shown(F.col("sketch"))).distinct()
    assert same.count() == 1


def test_sketches_merge_and_estimate_containment(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    long = " ".join(rng.choices(words, k=20_000))
    part = " ".join(long.split()[4000:4800])
    other = " ".join(rng.choices(words, k=700))
    df = spark.createDataFrame([(long, part, other)], "a string, b string, c string").select(*(fp.sketch(F.col(c)).alias(c) for c in "abc"), fp.sketch(F.concat_ws(" ", "a", "c")).alias("ac"))
    r = df.select(fp.contained(F.col("b"), F.col("a")).alias("b_in_a"), fp.contained(F.col("a"), F.col("b")).alias("a_in_b"), fp.contained(F.col("c"), F.col("a")).alias("c_in_a"), fp.merged(F.col("a"), F.col("c")).alias("m"), "ac", "a", "c").first()
    assert r.b_in_a == 1 and 0.02 < r.a_in_b < 0.06 and r.c_in_a == 0
    assert set(r.m) == set(r.a) | set(r.c) and len(set(r.ac) ^ set(r.m)) <= 4
    few = spark.createDataFrame([("a b",), ("c d",)], "t string").select(fp.sketch(F.col("t")).alias("s")).collect()
    assert all(len(x.s) == 1 for x in few)


LETTERS = "ABCDE"


def plain_audit(rows, labels):
    least, out, seen = {}, [], set()
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": least.get(t) is not None and (i is None or i > least[t])}
        mine = [x for x in labels if i is not None and x[0] == i]
        fails.append((part or "", {k for k, v in bad.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
        seen.add(part or "")
    for part in seen:
        here, total = [f[1:] for f in fails if f[0] == part], dict.fromkeys(LETTERS, 0)
        steps = []
        for order in itertools.permutations(LETTERS):
            left = here
            for k, c in enumerate(order):
                gone, left = [d for d in left if c in d[0]], [d for d in left if c not in d[0]]
                total[c] += len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), sum(c in d[0] for d in here) - len(gone), sum(d[0] == {c} for d in here), sum(d[1] for d in gone), sum(d[2] for d in gone), c))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return out


def test_audit_by_plain_loop(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "A B C", "word # " * 60, "Some Text Here " * 20, "x" * 400] + [" ".join(rng.choices(["aa", "Bb", "$", "cc"] + [f"w{k}" for k in range(80)], k=rng.randrange(30, 90))) for _ in range(25)]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(300)]
    rows += [(500 + i, texts[9], "hot") for i in range(120)] + [(1, texts[9], "s"), (1, texts[9], "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame([(i, t, "s", p, 9) for i, t, p in rows], "doc_id long, text string, n string, source string, subset int").repartition(4)
    known = spark.createDataFrame([(*x, "kept") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(table, known, F.col("source"))
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(rows, labels))
    assert filter_audit.audit(table.limit(0), known, F.col("source")).count() == 0
    assert sorted(map(tuple, filter_audit.audit(table, known.limit(0), F.col("source")).collect())) == sorted(plain_audit(rows, []))


def test_cuts_and_audit_match_sql(spark):
    import tempfile

    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(i, t, i % 3 and "s") for i, t in MORE if i is not None]
    spark.createDataFrame([(i, t, "en", s or None, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i, *_ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{top}/{t}.parquet/*.parquet')")
    for name in ("op11_checkpoint_cuts", "op13_filter_cube"):
        assert_same(QUERIES[name](spark, top), con.execute(ORACLE_SQL[name]))
