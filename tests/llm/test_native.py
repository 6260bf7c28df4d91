"""Quality rules, mixing and secret scans."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmap.llm import mixing, quality_rules, secret_scan
from quillmap.llm.common import written

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    spots = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(spots)


def test_measures_equal_brute_force(odd):
    book = quality_rules.ledger(odd)
    assert book.columns == [c for c in odd.columns if c not in ("m", "fail_bits")] + ["m", "fail_bits"]
    got = Counter((r["doc_id"], *[r["m"][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]) for r in book.collect())
    assert got == Counter((d, *measures(t)) for d, t, _ in ODD)


def test_policies_and_ablation(odd, none):
    book = quality_rules.ledger(odd, keep=("doc_id",)).cache()
    rows = book.collect()
    for policy in quality_rules.POLICIES:
        mask = policy.mask(quality_rules.RULES)
        kept = quality_rules.applied(book, policy).filter("kept").count()
        assert kept == sum(not r["fail_bits"] & mask for r in rows)
        for a in quality_rules.ablation(book, policy).collect():
            bit = next(1 << r.bit for r in quality_rules.RULES if r.name == a["rule"])
            bits = [r["fail_bits"] & mask for r in rows]
            assert (a["n_failed"], a["n_only_this"], a["n_kept_without"]) == (sum(b & bit > 0 for b in bits), bits.count(bit), sum(b & ~bit == 0 for b in bits))
    assert quality_rules.ledger(none).count() == 0


def wanted_targets(sizes):
    """Excess shared again and again until no source is over."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_meets_its_targets(spark, odd, none):
    rows = [(i, "w " * (1 + i * 7919 % 97), f"s{min(i % 11, 7)}", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mixed(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2 and r["size"] == 1 + r["doc_id"] * 7919 % 97
    want = wanted_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()))
    strange = mixing.mixed(odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in strange) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in ODD)
    assert all(r["copies"] == 0 for r in strange if not r["size"])
    assert mixing.mixed(none).count() == 0


def test_rounding_is_unbiased(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 2}", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").cache()
    mean = Counter()
    for seed in range(12):
        for r in mixing.mixed(docs, share=(1, 2), weights=(1,), seed=seed).collect():
            mean[r["size"]] += r["copies"] / 12 / 40
    assert all(abs(m - 0.5) < 0.15 for m in mean.values())


def brute_spans(text):
    found = []
    for k, rule in enumerate(secret_scan.RULES):
        loose = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}.get(rule.kind, rule.pattern)
        found += [(m.start(), k, m.end()) for m in re.finditer(loose, text or "") if len(m[rule.group]) >= rule.at_least]
    return sorted(found)


PIECES = st.sampled_from(["token=", 'api_key : "', "passwd", "secret='", "AKIA", "ABCDEFGH12", "0123456789abcdef", "abc", " ", "=", ":", "x" * 12, "é", "\U0001f600", "ghp_" + "a" * 36, "eyJ" + "a" * 10 + "." + "b" * 10 + ".c", "-----BEGIN RSA PRIVATE KEY-----", "\n"])


def test_spans_equal_brute_force(spark, odd, none):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.lists(PIECES, max_size=30).map("".join), min_size=300, max_size=400))
    def check(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = secret_scan.with_findings(docs, secret_scan.scanned(docs))
        for r in found.withColumn("masked", secret_scan.redacted(F.col("text"), F.col("secrets"))).collect():
            spans = [(s["start"], s["kind"], s["end"]) for s in r["secrets"]]
            assert spans == brute_spans(r["text"])
            hidden = set().union(*(range(a, b) for a, _, b in spans))
            assert r["masked"].replace(secret_scan.MASK, "") == "".join(c for i, c in enumerate(r["text"]) if i not in hidden)

    check()
    found = secret_scan.with_findings(odd, secret_scan.scanned(odd))
    assert Counter((r["doc_id"], len(r["secrets"])) for r in found.collect()) == Counter((d, len(brute_spans(t))) for d, t, _ in ODD)
    assert secret_scan.with_findings(none, secret_scan.scanned(none)).count() == 0


def test_texts_that_the_ledger_knows_are_not_moved(spark):
    docs = spark.createDataFrame([(k, f"token = abcdefghijklm{k}") for k in range(50)], "doc_id long, text string")
    first = written(secret_scan.scanned(docs), "ledger")
    more = docs.union(spark.createDataFrame([(99, "token = zzzzzzzzzzzzzz")], docs.schema))
    again = secret_scan.scanned(more, first)
    plan = again._jdf.queryExecution().executedPlan().toString()
    before = plan[: plan.index("BroadcastHashJoin")]  # what is above the join, nearer to the result
    assert "Exchange hashpartitioning(blob_id" in before and "SortMergeJoin" not in plan
    assert again.count() == 1


def test_long_encoded_runs_cost_their_length(spark):
    texts = ["eyJ" * 350_000, "-----BEGIN " * 90_000, "eyJ" + "z" * 20 + ".", "x eyJ" + "z" * 12 + ".eyJ" + "y" * 12 + ".c d", "eyJshort.eyJ" + "z" * 12 + "." + "y" * 11 + ".c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    found = secret_scan.with_findings(docs, secret_scan.scanned(docs)).select("doc_id", secret_scan.listed(F.col("secrets")).alias("s")).collect()
    assert time.perf_counter() - began < 20
    assert {r["doc_id"]: r["s"] for r in found} == {0: "", 1: "", 2: "", 3: "jwt:2:35", 4: "jwt:9:38"}


def test_the_ledger_grows_by_what_it_lacks(spark):
    docs = spark.createDataFrame([(1, "token=aaaaaaaaaaaaaa"), (2, "token=aaaaaaaaaaaaaa"), (3, "b")], "doc_id long, text string")
    first = secret_scan.scanned(docs).cache()
    assert first.count() == 2
    assert secret_scan.scanned(docs, first).count() == 0
    more = docs.union(spark.createDataFrame([(4, "0123456789abcdef00")], docs.schema))
    assert [r["blob_id"] for r in secret_scan.scanned(more, first).collect()] == [hashlib.sha256(b"0123456789abcdef00").hexdigest()]
    rules = (*secret_scan.RULES[:2], secret_scan.Rule("hex", 2, "[0-9a-f]{18,}"))
    second = secret_scan.scanned(more, first, rules=rules)
    assert sorted(len(r["rules"]) for r in second.collect()) == [1, 1, 3]
    found = secret_scan.with_findings(more, first.union(second), rules=rules)
    assert {r["doc_id"]: len(r["secrets"]) for r in found.collect()} == {1: 1, 2: 1, 3: 0, 4: 1}


def test_running_totals(spark):
    data = [[], [3], list(range(-5, 400))]
    rows = spark.createDataFrame([(x,) for x in data], "v array<long>").select("v", secret_scan.running(F.col("v"), lambda a, b: a + b, F.lit(0).cast("long"), 16).alias("s"))
    for r in rows.collect():
        assert r["s"] == [sum(r["v"][: k + 1]) for k in range(len(r["v"]))]
