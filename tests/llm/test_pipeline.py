"""The pipeline's stages on a small table, against plain Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillmap.llm import decontamination, quality_rules, secret_scan
from quillmap.llm.common import written


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "secret scans", "mixing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small), name.replace(" ", "-"))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert docs.count() == len(kept[-1])
    rules, near, clean, masked = kept
    good = {r["doc_id"] for r in quality_rules.ledger(spark.read.parquet(f"{small}/documents.parquet")).filter("fail_bits = 0").collect()}
    assert set(rules) == good
    # Brute force: the similarity of five-word shingle sets.
    sets = {d: frozenset(zip(*(r["text"].lower().split()[k:] for k in range(5)), strict=False)) for d, r in rules.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    groups = {d: d for d in sets}
    for _ in range(3):
        for a in sets:
            groups[a] = min(groups[b] for b in sets if alike(a, b))
    assert set(near) <= set(rules) and set(groups.values()) <= set(near)
    assert len(near) - len(set(groups.values())) <= 1  # SimHash may miss a pair near the bound
    leaky = {d for d, r in near.items() if any(i in r["text"] for i in items)}
    assert leaky and not leaky & set(clean) and len(near) - len(clean) <= len(leaky) + 1
    assert set(masked) == set(clean)
    secret = re.compile(secret_scan.RULES[0].pattern)
    for d, r in masked.items():
        assert r["text"] == before[d]["text"] or (secret_scan.MASK in r["text"] and r["n_chars"] == len(r["text"]))
        assert not any(len(m[2]) >= 12 for m in secret.finditer(r["text"]))
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies) <= set(masked) and max(copies.values()) <= 2
    assert all(r["text"] == masked[r["doc_id"]]["text"] for r in mixed)
    assert decontamination.WINDOW == 100


def test_private_keys_are_masked_whole(spark, small):
    lines = ["MIIEpAIBAAKCAQEA" + "aB3/+" * 9, "Zq" * 30, "short+tail=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = "\n".join(lines)
    texts = [
        f"before {begin}\n{body}\n{end} after",
        f"before {begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{body}\n{end} after",
        f"before {begin}\\n{lines[0]}\\n{lines[1]}\\n{end} after",
        f"before {begin}\n{body} after",
        f"before {begin} after all that",
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets_masked(spark, docs, small).collect()}
    assert got == {k: "before [SECRET] after" + (" all that" if k == 4 else "") for k in range(5)}


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows == [] or set(rows[0].asDict()) == {*corpus_pipeline.COLUMNS, "copy"}
    again = corpus_pipeline.run(spark, small)
    assert Counter((r["doc_id"], r["copy"]) for r in rows) == Counter((r["doc_id"], r["copy"]) for r in again.collect())


def test_empty(spark, small, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, odd, none, small):
    docs = odd.withColumn("lang", F.lit(None).cast("string"))
    n = docs.count()
    for (name, stage), least in zip(corpus_pipeline.STAGES, (2, 5, n, n, 3), strict=True):
        got = stage(spark, docs, small)
        assert got.columns[:5] == list(corpus_pipeline.COLUMNS)
        assert least <= got.count() <= 2 * n, name
        assert stage(spark, none.withColumn("lang", F.lit("")), small).count() == 0, name
    near = corpus_pipeline.near_duplicates(spark, docs, small).collect()
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == [1, 2, 5, 6, 8, 9] and sum(r["doc_id"] is None for r in near) == 1
