"""Registered queries beside their oracles, and the pipeline's stages against brute force on small tables."""

import os
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from oracle import compare, connect
from test_copies import plain_fingerprint, plain_group
from test_passages import plain
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from sightline.llm.catalog import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {"op1": {"doc_id", "held_out", "lang_pred", "score"}, "op2": {"vec_id", "n_links", "component_id", "kept"}, "op3": {"doc_id", "fingerprint", "component_id"},
           "op5": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}, "op6": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
           "op7": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op9": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
           "op10": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op11": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
           "op12": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
           "op13": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) and COLUMNS.get(name.split("_")[0], set()) <= set(got.columns)
    if name in ORACLES:
        assert compare(got, connect(SF).sql(ORACLES[name]).df()) is None


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = ["the quick brown fox runs over the lazy dog and far away", "the quick  brown fox runs over the lazy dog and far away\n", None, "", " 12 34 ",
             f"{long} here the first ends", f"begin another {long}", "der schnelle braune Fuchs läuft über den faulen Hund", "der schnelle braune Fuchs läuft über den faulen Hund"]
    rows = [(i, t, "de" if t and t.startswith("der") else "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, content string")


@pytest.mark.parametrize("which", ["table", "odd"])
def test_stages(spark, tmp_path, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "table" else odd_documents(spark)
    held = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            break
        assert docs.columns == corpus_pipeline.COLUMNS
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(got)
        if name == "language":
            want = {i: t for i, t in held.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(held):
                first.setdefault(" ".join(("." + (held[i] or "") + ".").split()), i)
            want = {i: held[i] for i in first.values()}
        elif name == "near_dedup":
            prints = {i: plain_fingerprint(t) for i, t in held.items()}
            group = plain_group(list(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
            want = {i: t for i, t in held.items() if group[i] == i}
        else:
            order = sorted(held)
            want = {i: held[i] if not gone else kept for i, (_, gone, kept) in zip(order, plain([held[i] for i in order], 35))}
            assert {r.doc_id: r.n_chars for r in docs.collect() if r.text != held[r.doc_id]} == {i: len(t) for i, t in want.items() if t != held[i]}
        assert got == want, name
        held = got
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    reach = Counter()
    for r in sorted(docs.collect(), key=lambda r: (r.sequence_id, r.offset)):
        ids = np.array([*whole.encode(held[r.doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")[r.start:r.start + r.length]
        assert (len(ids), zlib.crc32(ids.tobytes()), reach[r.sequence_id]) == (r.length, r.ids_crc32, r.offset)
        reach[r.sequence_id] += r.length
    assert {r.doc_id for r in docs.collect()} == set(held)


def test_shared_and_missing_identifiers(spark):
    say = lambda word: " ".join(f"{word}{i} and" for i in range(30))
    rows = [(5, say("apple")), (3, say("apple")), (5, say("pear")), (None, say("pear")), (None, say("plum")), (7, "12 34"), (7, say("fig")), (8, say("fig")), (8, say("fig"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    got = sorted([(str(r.doc_id), r.text.split()[0]) for r in docs.collect()])
    assert got == [("3", "apple0"), ("5", "pear0"), ("7", "fig0"), ("None", "plum0")]
    repeated = spark.createDataFrame([(1, "x " * 40, "en", "s", 80), (1, "y " * 40, "en", "s", 80), (None, "x " * 40, "en", "s", 80), (1, "x " * 40, "en", "s", 80)], docs.schema)
    cleaned = corpus_pipeline.recurring_passages(spark, repeated, SF)
    assert sorted(str(tuple(r)) for r in cleaned.collect()) == sorted(str((i, "", "en", "s", 0)) for i in (1, 1, None, 1))


def test_repeated_keepers_and_copies_without_identifier(spark, tmp_path):
    say = lambda word: " ".join(f"{word}{i} and" for i in range(30))
    rows = [(1, say("apple"), "s"), (1, say("apple"), "r"), (1, say("apple"), "s"), (2, say("apple"), "s"), (None, say("plum"), "s"), (None, say("plum"), "s"), (None, say("plum"), None),
            (None, say("pear"), "s"), (4, say("fig"), "s"), (4, say("fig"), "s"), (6, None, "s"), (6, None, "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = sorted([("1", say("apple"), "r"), ("None", say("plum"), "None"), ("None", say("pear"), "s"), ("4", say("fig"), "s")])
    alone = spark.createDataFrame(docs.where("doc_id = 1 OR doc_id = 4").collect(), docs.schema)
    assert sorted((r.doc_id, r.source) for r in corpus_pipeline.near_duplicates(spark, alone, SF).collect()) == [(1, "r"), (4, "s")]
    assert corpus_pipeline.exact_copies(spark, docs, SF).where("doc_id = 6").count() == 1
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name in ("exact_dedup", "near_dedup", "substring_dedup"):
            assert sorted((str(r.doc_id), r.text, str(r.source)) for r in docs.collect()) == want, name
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert docs.agg({"length": "sum"}).first()[0] == sum(len(whole.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in want)


def test_language_stage_decides(spark):
    """Noise and a language that nobody labelled go; every labelled document stays; without labels all stay."""
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang <> 'fr'").select(*corpus_pipeline.COLUMNS)
    foreign = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'fr' AND n_chars > 500").select((F.col("doc_id") + 10000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    draw = np.random.default_rng(3)
    noise = [(20000 + i, "".join(draw.choice(list("zqxjkvwpfыжщ  "), 2000)), None, "s", 2000) for i in range(5)]
    docs = known.unionByName(foreign).unionByName(spark.createDataFrame(noise, known.schema))
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()}
    want = {r.doc_id for r in known.collect() if any(c.isalpha() for c in r.text or "")}
    assert want <= kept and not {i for i in kept if i >= 20000}
    assert len({i for i in kept if 10000 <= i < 20000}) <= 0.05 * foreign.count()
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.known_language(spark, unlabelled, SF).count() == docs.count()


def test_stages_of_nothing(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
