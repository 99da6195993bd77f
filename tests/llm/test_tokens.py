import hashlib

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sightline.llm import queries as q
from sightline.llm import common, token_counts
from sightline.llm.sentence_pieces import PieceCodec, codec
from sightline.llm.token_counts import counter

from .helpers import frame, odd_texts, write

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIB, SP = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
mixed = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tabcthe'sé1２日▁\x85\xa0　𠮷-_")), st.characters(blacklist_categories=["Cs"])), max_size=120)


@settings(max_examples=300, deadline=None)
@given(mixed)
def test_counts_as_the_library(text):
    assert counter(BPE).count(text) == len(LIB.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(mixed)
def test_pieces_as_the_library(text):
    ids = codec(PIECES).encode(text)
    assert ids == SP.encode(text)
    assert codec(PIECES).decode(ids) == SP.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 260)), max_size=12))
def test_any_ids_decode_as_the_library(ids):
    assert codec(PIECES).decode(ids) == SP.decode(ids)


def test_runs_of_spaces_and_long_words():
    for text in [" " * n for n in range(70)] + ["ab" * 2000, "日本語" * 300, "\n" * 40]:
        assert codec(PIECES).encode(text) == SP.encode(text)
        assert counter(BPE).count(text) == len(LIB.encode(text, add_special_tokens=False).ids)


def test_queries_over_odd_documents(spark, tmp_path):
    texts = odd_texts()
    d = write(tmp_path, documents=frame(spark, [*texts.items(), (9, texts[9])]))
    counts = q.op7_token_counts(spark, d).collect()
    assert len(counts) == len(texts) + 1
    for r in counts:
        text = texts[r["doc_id"]] or ""
        n = len(LIB.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in q.op3_sentence_pieces(spark, d).collect():
        ids = SP.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids)))


def test_empty_table(spark, tmp_path):
    d = write(tmp_path, documents=frame(spark, {}))
    assert q.op7_token_counts(spark, d).count() == q.op3_sentence_pieces(spark, d).count() == 0


def test_counts_of_empty_tables_and_clashing_columns(spark):
    clash = frame(spark, [(1, "one two"), (None, None)]).withColumnsRenamed({"h": "n_bytes", "row": "n_tokens"})
    got = token_counts.count_tokens(clash, public_tokenizers.path("byte_bpe_50k.json"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((x["n_bytes"], x["n_tokens"]) for x in got.collect()) == [(0, 0), (7, 2)]
    assert token_counts.count_tokens(clash.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_marks_are_cut_off_only_where_no_piece_joins_them():
    c = codec(PIECES)
    for text in ("Word, word. WORD!! 1,234,567.89 x²., _a_. __b__, 'c'. \"d\", (e). f::g :: h;i é. 日本. ß! a.b.c ... .x", " a,b  c.▁d ,, e ▁.", "\n.a\n,b.\n", "²,²."):
        assert c.encode(text) == SP.encode(text) and c.decode(SP.encode(text)) == SP.decode(SP.encode(text))
    assert {"word", "."} <= set(c.chunks("word.")) and c.chunks("x².") == ["x²."]


def test_what_is_met_again_stays_known():
    c = PieceCodec(PIECES, 64)
    for i in range(500):
        assert c.encode(f"always w{i}q") == SP.encode(f"always w{i}q")
        assert " always" in c.known or " always" in c.older
    assert len(c.known) <= 32 and len(c.older) <= 32


def test_a_worker_forgets_what_other_stages_remembered(spark):
    def held(rows):
        list(rows)
        yield (len(common._memory),)

    def learn(rows):
        common.remembered(dict)
        return held(rows)

    df = spark.range(8).coalesce(1)
    count = lambda f, keeps: common.map_rows(df, ["id"], "n int", f, keeps=keeps).first()["n"]
    assert count(learn, True) == 1 and count(held, False) == 0
