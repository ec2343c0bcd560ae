"""I-Match: edited texts by hand, likeness and edges."""

import hashlib
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F
from recordlens.llm import imatch


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        out[d] = t[: len(t) - third] + following[:third]
    return out


def test_tables(spark):
    path = "/root/testdata/sf0.001"
    found = imatch.op6_imatch(spark, path).toPandas().set_index("doc_id")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = edited(rows)
    assert len(found) == len(rows)
    for d, t in rows:
        assert found.loc[d, "edited_sha256"] == hashlib.sha256(want[d].encode()).hexdigest() and found.loc[d, "n_chars"] == len(t)
    assert found["near_edited"].mean() > 0.25 and found["near_next"].mean() < 0.05
    assert found["near_edited"].between(0, 1).all() and found["near_next"].between(0, 1).all()


def test_next_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7 % 5003).alias("doc_id")).withColumns({"v": F.col("doc_id").cast("string"), "t": F.lit(0)})
    found = {r["doc_id"]: r["nx"] for r in imatch.with_next(rows, "v", "t", "nx").collect()}
    ids = sorted(found, reverse=True)
    assert all(found[a] == str(b) for a, b in zip(ids, ids[1:] + ids[:1]))


def parts(*given):
    return "".join(given).ljust(imatch.LEXICONS * 4, "-")


def test_likeness(spark):
    many = [f"{k:04x}" for k in range(30)]
    rows = [
        (parts("aaaa", "bbbb"), parts("aaaa", "cccc"), 0.5), ("", parts("aaaa"), 0.0), (None, "x", 0.0), (parts("aaaa"), parts("aaaa"), 1.0), ("", "", 1.0),
        (parts("aaaa"), parts("----", "bbbb"), 0.0), (parts(*many), parts(*many[:12], *["ffff"] * 18), 12 / 16),
    ]
    found = spark.createDataFrame(rows, "a string, b string, want double").select(imatch.likeness(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in found)


def plain_terms(text):
    return {t for t in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if t}


def plain_fingerprint(terms):
    """Hashes of the sorted distinct terms in each lexicon, the smallest lexicons first."""
    if not terms:
        return ""
    codes = {xxhash.xxh64_intdigest(t.encode(), 42) for t in terms}
    signed = sorted(c - 2**64 if c >= 2**63 else c for c in codes)
    again = [xxhash.xxh64_intdigest((c % 2**64).to_bytes(8, "little"), 42) for c in signed]
    second = sorted(c - 2**64 if c >= 2**63 else c for c in again)
    found = []
    for r in [*range(imatch.QUARTERS, 0, -1), 0]:
        for family in range(imatch.FAMILIES if r else 1):
            base = signed if family < 8 else second
            own = [c for c in base if not (c >> family % 8 * 8) & (4**r - 1)]
            h = 42
            for c in own:
                h = xxhash.xxh64_intdigest((c % 2**64).to_bytes(8, "little"), h)
            found.append(f"{h:016x}"[-4:] if own else "----")
    return "".join(found)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    both = [(a[k : k + 4], b[k : k + 4]) for k in range(0, len(a), 4)]
    seen = [(x, y) for x, y in both if (x, y) != ("----", "----")][: imatch.COMPARED]
    return sum(x == y for x, y in seen) / len(seen)


def test_against_plain_version(spark):
    """Lexicon, fingerprints and likeness of a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    other = edited(rows)
    held = Counter(t for _, text in rows for t in plain_terms(text))
    low, high = (max(2.0, share * len(rows)) for share in imatch.BAND)
    band = {t for t, n in held.items() if low <= n <= high}
    assert {r["term"] for r in imatch.lexicon(docs).collect()} == band
    own = lambda text: plain_terms(text) & band or plain_terms(text)
    want = {d: (plain_fingerprint(own(text)), plain_fingerprint(own(other[d]))) for d, text in rows}
    following = {d: rows[(k + 1) % len(rows)][0] for k, (d, _) in enumerate(rows)}
    for r in imatch.edited_fingerprints(docs).collect():
        d = r["doc_id"]
        assert (r["fingerprint"], r["edited_fingerprint"]) == want[d]
        assert r["near_edited"] == plain_likeness(*want[d]) and r["near_next"] == plain_likeness(want[d][0], want[following[d]][0])


def test_likeness_is_that_of_the_returned_fingerprints(spark):
    found = imatch.op6_imatch(spark, "/root/testdata/sf0.01").collect()
    own = {r["doc_id"]: r["fingerprint"] for r in found}
    order = sorted(own, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    for r in found:
        assert r["near_edited"] == plain_likeness(r["fingerprint"], r["edited_fingerprint"]), r["doc_id"]
        assert r["near_next"] == plain_likeness(r["fingerprint"], own[following[r["doc_id"]]]), r["doc_id"]


def test_identical_documents(spark):
    text = " ".join(f"same{k}" for k in range(60))
    found = imatch.edited_fingerprints(spark.createDataFrame([(k, text) for k in range(300)], "doc_id long, text string")).collect()
    assert len({r["fingerprint"] for r in found}) == 1 and found[0]["fingerprint"] and {r["near_next"] for r in found} == {1.0}


def test_next_with_nulls_and_repeats(spark):
    rows = [(None if k % 3 == 0 else k // 7 % 400, f"v{k % 50}") for k in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, v string").withColumn("t", F.xxhash64("v"))
    found = imatch.with_next(frame, "v", "t", "nx").collect()
    order = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["t"], r["v"]) for r in found), reverse=True)
    pairs = Counter((a, b[2]) for a, b in zip(order, order[1:] + order[:1]))
    assert pairs == Counter(((-1 if r["doc_id"] is None else r["doc_id"], r["t"], r["v"]), r["nx"]) for r in found)


def test_edges(spark):
    rows = [(5, "one two three four"), (5, "one two three four"), (4, None), (3, ""), (None, "one two three four"), (2, "!!! ???"), (1, "é\U0001f600 x" * 60_000)]
    docs = spark.createDataFrame([(d, t, "mine") for d, t in rows], "doc_id long, text string, fingerprint string")
    found = imatch.edited_fingerprints(docs).collect()
    assert len(found) == len(rows)
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (5, None)}) == 1
    assert sorted(r["n_chars"] for r in found) == sorted(len(t or "") for _, t in rows)
    assert {r["doc_id"]: r["near_edited"] for r in found if r["doc_id"] in (2, 3, 4)} == {2: 0.0, 3: 1.0, 4: 1.0}
    assert imatch.edited_fingerprints(docs.limit(0)).count() == 0


def test_single_row(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    row = imatch.edited_fingerprints(docs).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def test_marks_passed(spark):
    marks = [k * k - 300 for k in range(1, 700)]
    rows = spark.range(-1000, 500_000, 37).select(F.col("id").alias("doc_id"))
    for some in (marks, marks[:1], marks[:50], []):
        found = rows.select("doc_id", imatch._marks_passed(some).alias("n")).collect()
        assert all(r["n"] == sum(m <= r["doc_id"] for m in some) for r in found[:: max(1, len(some) // 20)])


def test_long_texts_without_terms_in_the_band(spark):
    many = " ".join(f"copied{k}" for k in range(60))  # in half of all rows
    rare = [" ".join(f"own{d}x{k}" for k in range(60)) for d in range(3)]  # each term in one row
    rest = [" ".join(f"word{d * k % 97}" for k in range(1, 40)) for d in range(100, 200)]
    rows = [(d, many) for d in range(100)] + [(d, t) for d, t in enumerate(rest, 100)] + [(d, t) for d, t in enumerate(rare, 200)]
    found = {r["doc_id"]: r for r in imatch.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r["fingerprint"] and r["edited_fingerprint"] for r in found.values())
    assert all(found[d]["near_next"] == 1.0 for d in range(1, 100))  # exact copies
    near = [found[d]["near_edited"] for d in [*range(100), 200, 201, 202]]
    assert min(near) > 0.1 and sum(near) / len(near) > 0.25
    assert all(found[d]["near_next"] < 0.1 for d in (0, 200, 201, 202))


def test_lexicon_of_any_size(spark, monkeypatch):
    """Looked up in the row or joined by a shuffle, the fingerprints are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, "zzqx zzqy"), (-2, "zzqx zzqy")], "doc_id long, text string"))
    small = sorted(map(str, imatch.edited_fingerprints(docs).collect()))
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    assert sorted(map(str, imatch.edited_fingerprints(docs).collect())) == small
