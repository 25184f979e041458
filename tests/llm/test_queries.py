"""The registered queries over the given tables, against their SQL or a brute-force version."""

import os
import zlib

import pytest

from compare import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", ["op5_decontamination", "op7_exact_dedup", "op11_conversation_trie", "op12_fill_in_middle"])
def test_query_equals_sql(spark, name):
    from duelmark.llm.catalog import ORACLES, QUERIES

    status, _, _, note = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert status == "ok", note


@pytest.mark.parametrize("name, label, least", [("op8_toxicity", "toxic", 0.5), ("op9_quality", "quality", 0.7)])
def test_models_beat_the_base_rate_on_held_out_rows(spark, name, label, least):
    from duelmark.llm.catalog import QUERIES

    got = QUERIES[name](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= least) == (got.predicted == 1)).all()
    m = got.merge(labels, on="doc_id")
    assert (m[m.held_out].predicted == m[m.held_out][label]).mean() >= max(m[label].mean(), 1 - m[label].mean()) - 0.1


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Every stage's rule again in plain Python, on what the stage before kept."""
    import corpus_pipeline
    from duelmark.llm.simhash import fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id: r.text or "" for r in docs.collect()})

    toxic_free, exact, near, clean = kept
    groups = {}
    for i, t in toxic_free.items():
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i))
    assert set(exact) == {min(g)[1] for g in groups.values()}
    prints = {i: fingerprint(t.encode()) for i, t in exact.items()}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    assert set(near) == {find(i) for i in ids}
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shingled = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in items]

    def hit(text):
        w = text.lower().split()
        have = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        return any(len(s & have) >= 0.8 * len(s) for s in shingled)

    assert set(clean) == {i for i, t in near.items() if not hit(t)}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(clean) and all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)


COLUMNS = {
    "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op3_simhash": "doc_id fingerprint component_id", "op4_html": "page_id url text n_chars",
    "op6_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op13_best_fit": "doc_id piece start length ids_crc32 sequence_id offset"}


@pytest.mark.parametrize("name", COLUMNS)
def test_every_query_covers_its_table(spark, name):
    from duelmark.llm.catalog import QUERIES

    table, key = ("pages", "page_id") if name in ("op2_warc", "op4_html") else ("documents", "doc_id")
    got = QUERIES[name](spark, SF).toPandas()
    ids = {r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert set(COLUMNS[name].split()) <= set(got.columns) and set(got[key]) == ids
    if "sequence_id" not in got:
        assert len(got) == len(ids)


def test_best_fit_needs_few_sequences(spark):
    from duelmark.llm.catalog import QUERIES

    got = QUERIES["op13_best_fit"](spark, SF).toPandas().sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id").length
    assert ((by.cumsum() - got.length) == got.offset).all() and by.sum().max() <= 2048
    assert by.ngroups <= -(-int(got.length.sum()) // 2048) + 2
    pieces = got.sort_values(["doc_id", "piece"]).groupby("doc_id")
    assert (pieces.piece.cumcount() == got.sort_values(["doc_id", "piece"]).piece).all() and (got.start == 2048 * got.piece).all()
