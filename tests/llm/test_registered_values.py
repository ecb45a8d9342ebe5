"""What the registered queries return on a whole small table, value by value, where SQL has no form for it."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_periodic import plain_runs
from tokenizers import Tokenizer

from sightline.llm.catalog import QUERIES
from sightline.llm.token_counts import ADDRESS, NUMBER

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op7(spark, texts):
    whole, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for i in sorted(texts):
        ids = np.array([*whole.encode(texts[i], add_special_tokens=False).ids, 1], dtype="<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op7_token_files"](spark, SF).collect()} == want


def test_op8(spark, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda text: len(whole.encode(text, add_special_tokens=False).ids)
    want = {}
    for i, text in texts.items():
        spans = sorted([(m.start(), m.end(), "[number]") for m in re.finditer(NUMBER, text)] + [(m.start(), m.end(), "[address]") for m in re.finditer(ADDRESS, text)])
        clear, last = [], 0
        for a, b, mask in spans:
            if a >= last:
                clear.append((a, b, mask))
                last = b
        masked = text
        for a, b, mask in reversed(clear):
            masked = masked[:a] + mask + masked[b:]
        want[i] = (len(clear), count(text), count(masked))
    assert {r.doc_id: (r.n_edits, r.n_tokens_before, r.n_tokens) for r in QUERIES["op8_token_counts"](spark, SF).collect()} == want
    assert any(n for n, _, _ in want.values())


def test_op11(spark, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, text in texts.items():
        ids = whole.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_byte_pairs"](spark, SF).collect()} == want


def test_op12(spark, texts):
    want, planted = {}, 0
    for i, text in texts.items():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = plain_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want[i] = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
                   sha(" ".join(w for k, w in enumerate(words) if k not in gone)))
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert got == want and planted > 10
