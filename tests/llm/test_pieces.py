import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pacelane.llm.pieces import MARK, ChunkTable, decode_ids, piece_codes, words_of

ODD = ["", " ", "  ", "a ", " a", "a  b  ", "\n a", f"{MARK}x", f"x{MARK}{MARK}", "é\x00b", "ﬁ ½", "😀 😀x", "<s> </s> <0x0A>", "�", "a" * 3000, " " * 3000, f" {MARK} "]


def check(processor, table, text):
    words = words_of(text)
    table.learn(set(words))
    ids = processor.encode(text)
    assert table.joined(words) == ",".join(map(str, ids))
    assert table.decoded(words) == processor.decode(ids)


def test_library_ids_on_odd_texts(model):
    processor, table = sentencepiece.SentencePieceProcessor(model_proto=model), ChunkTable(model, limit=5)
    for text in ODD:
        check(processor, table, text)


def test_library_ids_on_any_text(model):
    processor, table = sentencepiece.SentencePieceProcessor(model_proto=model), ChunkTable(model, limit=50)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tab"), st.characters(exclude_categories=("Cs",))), max_size=40))
    def run(text):
        check(processor, table, text)

    run()


def test_rows_and_round_trip(spark, docs, model):
    frame = docs([(1, "a  b"), (2, None), (3, ""), (3, "twice"), (None, "no id"), (4, "long text " * 20000)])
    found = piece_codes(frame, model)
    rows = {(r.doc_id, r.decoded): r for r in found.collect()}
    assert set(rows) == {(1, "a  b"), (2, ""), (3, ""), (3, "twice"), (None, "no id"), (4, "long text " * 20000)}
    assert rows[(2, "")].n_tokens == 0 and rows[(2, "")].ids == []
    assert {(r.doc_id, r.decoded) for r in decode_ids(found, model).collect()} == set(rows)
    digest = {r.doc_id: r for r in piece_codes(frame.where("doc_id = 1"), model, digest=True).collect()}[1]
    assert digest.ids_sha256 == hashlib.sha256(",".join(map(str, rows[(1, "a  b")].ids)).encode()).hexdigest()


def test_empty_table(spark, docs, model):
    assert piece_codes(docs([]), model).count() == 0
