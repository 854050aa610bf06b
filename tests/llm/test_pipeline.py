"""The pipeline's stages against brute-force versions, and on small odd inputs."""

from collections import Counter

import corpus_pipeline as C
import pytest
from test_feistel_pii import plain as plain_pii
from test_minmax_dedup import brute as brute_dedup
from test_packing import check as check_packing

from revwise.llm import mixing

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, `shard no` int"
ODD = [(1, None, "en", "a", None, "s", 1), (2, "", None, None, 0, None, 2), (3, "123", "en", "a", 3, "s", 3),
       (None, "the cat and the dog sat", "en", "a", 23, "s", 4), (5, "the cat and the dog sat", None, None, 23, "s", 5),
       (6, "the cat and the dog sat", "en", "b", 23, "s", 6), (6, "the cat and the dog sat", "en", "b", 23, "s", 6),
       (7, "le chat et le chien " * 3000, "fr", "b", 60000, "s", 7), (8, "call 743-555-3824 le chien", "fr", "b", 26, "s", 8)]


def test_stage_order():
    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "pii", "source_mix", "packing"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows after each stage at the smallest size, each stage on the one before, as ``run`` does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        result = stage(spark, docs, SF)
        if k < 4:
            assert result.columns == docs.columns
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_stages_against_brute_force(kept):
    start, lang, dedup, pii, mix, packed = kept
    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in lang} == set()  # every text there has a language
    keep = {d for d, x in brute_dedup([(r["doc_id"], r["text"]) for r in lang]).items() if x[2]}
    assert {r["doc_id"] for r in dedup} == keep and len(keep) < len(lang)
    assert {r["doc_id"]: r["text"] for r in pii} == {r["doc_id"]: plain_pii(r["text"])[0] for r in dedup}
    words = lambda t: Counter(mixing._WORDS.findall(t or ""))
    whole = {r["doc_id"]: words(r["text"]) for r in pii}
    taken = {}
    for r in mix:
        taken[r["doc_id"]] = taken.get(r["doc_id"], Counter()) + words(r["text"])
        assert len(r["text"]) == r["n_chars"]
    assert all(n <= 2 * whole[d][w] for d, c in taken.items() for w, n in c.items())
    total = sum(sum(c.values()) for c in whole.values())
    assert abs(sum(sum(c.values()) for c in taken.values()) / total - 1.5) < 0.05
    assert sum(r["length"] for r in packed) and len(packed) >= len(mix)


def test_packing_stage_holds_the_mix(spark, kept):
    docs = [(r["doc_id"], r["text"]) for r in kept[4]]
    check_packing(kept[5], docs)


def test_run(spark, kept):
    rows = C.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, kept[5]))


@pytest.mark.parametrize("k", range(5))
def test_each_stage_on_odd_rows(spark, k):
    docs = spark.createDataFrame(ODD, SCHEMA)
    name, stage = C.STAGES[k]
    rows = stage(spark, docs, SF).collect()
    ids = Counter(r["doc_id"] for r in rows)
    if name == "language_id":
        assert ids == Counter({None: 1, 5: 1, 6: 2, 7: 1, 8: 1})
        assert {r["doc_id"]: r["lang"] for r in rows}[5] == "en"
    elif name == "near_dedup":
        assert ids == Counter([1, 2, 3, None, 5, 7, 8])
    elif name == "pii":
        assert ids == Counter([r[0] for r in ODD]) and all("3824" not in (r["text"] or "") for r in rows)
    elif name == "source_mix":
        assert set(ids) <= {3, None, 5, 6, 7, 8} and 7 in ids
    else:
        assert set(ids) == {r[0] for r in ODD}
    if k < 4:
        assert rows[0].__fields__ == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_of_one_id_go_or_stay_by_their_text(spark):
    a, b = "the cat and the dog sat on the mat", "a text that no other row holds at all"
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b + " x y"), (None, a)]
    docs = spark.createDataFrame([(d, t, "en", "a", 0, "s", 1) for d, t in rows], SCHEMA)
    got = C.drop_near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter([(1, a), (5, b), (5, b), (7, b + " x y"), (None, a)])


def test_packed_sequences_of_the_mix_can_be_rebuilt(spark, kept, tmp_path):
    from revwise.llm import packing
    assert len({(r["doc_id"], r["piece"]) for r in kept[5]}) < len(kept[5])  # documents of several epochs
    path = str(tmp_path / "packed")
    docs = spark.createDataFrame(kept[4])
    C.pack_sequences(spark, docs, SF).write.parquet(path)
    packed = spark.read.parquet(path)
    import public_tokenizers
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    ids = {(r["text_key"], r["piece"]): bytes(r["ids"]) for r in packing.tokenized_pieces(docs, tokenizer).collect()}
    rows = packed.collect()
    whole = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        whole[r["sequence_id"]] = whole.get(r["sequence_id"], b"") + ids[r["text_key"], r["piece"]]
    built = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(docs, packed, tokenizer).collect()}
    assert built == whole and sum(map(len, whole.values())) == 4 * sum(r["length"] for r in rows)
