"""The piece codec against the sentencepiece library."""

import hashlib
import random

import pytest

ODD = [
    "", "  a  b   c", "a\tb\n\nc", "▁▁x▁", "\x00a\x01", "x" * 3000, " " * 77, "日本語のテキスト" * 40, "é" * 100, "\U0001f600☃ ünï", "<s></s><unk><0x41>", "aaaa bbbb 12345 1.5 a", " ", "\n", " \n ",
    "a" + " " * 40 + "b", "ꙮ ﷽ 𐍈", "word " * 20000, "́é", "nothing. Nothing",
]


@pytest.fixture(scope="module")
def vocabulary():
    from tidemark.llm.pieces import MergeVocabulary, default_model

    return MergeVocabulary(default_model())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" ▁abcetian.,1é日😀\n") for _ in range(rng.randint(0, 80))) for _ in range(400)]


def plain(vocabulary, text):
    """The best adjacent pair again and again, over the whole text, without agenda or units."""
    symbols = list(vocabulary.library.normalize(text))
    ids = {vocabulary.library.id_to_piece(i): i for i in range(259, vocabulary.size)}
    while True:
        pairs = [(-vocabulary.library.get_score(ids[a + b]), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in ids]
        if not pairs:
            return [i for s in symbols for i in ([ids[s]] if s in ids else [3 + b for b in s.encode()])]
        k = min(pairs)[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def test_agenda_equals_library_and_plain_form(vocabulary, texts):
    import numpy as np

    ids, sizes = vocabulary.encode(texts)
    ends = np.cumsum(sizes)
    own = [ids[e - n : e].tolist() for n, e in zip(sizes, ends, strict=True)]
    assert own == vocabulary.library.encode(texts)
    short = [k for k, t in enumerate(texts) if len(t) < 60][:120]
    assert [own[k] for k in short] == [plain(vocabulary, texts[k]) for k in short]


def test_both_forms_of_the_agenda_agree(vocabulary, texts, monkeypatch):
    from tidemark.llm import pieces

    ids, sizes = vocabulary.encode(texts)
    monkeypatch.setattr(pieces, "WIDTHS", ())  # all units by the heap
    again, others = vocabulary.encode(texts)
    assert ids.tolist() == again.tolist() and sizes.tolist() == others.tolist()
    monkeypatch.setattr(vocabulary, "crossing", True)  # a text is one unit
    whole, others = vocabulary.encode(texts)
    assert ids.tolist() == whole.tolist() and sizes.tolist() == others.tolist()


def test_encode_and_decode_documents(spark, vocabulary, texts):
    from tidemark.llm.pieces import decode_documents, default_model, encode_documents

    rows = [(k, t, "mine", 7) for k, t in enumerate([*texts, texts[1], None])] + [(None, "no id", "mine", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `c0` int")
    made = encode_documents(docs, default_model())
    assert made.columns == ["doc_id", "text", "c0", "ids", "decoded", "agrees"]
    found = {r.doc_id: r for r in made.collect()}
    assert len(found) == len(rows)
    for k, t, *_ in rows:
        want = vocabulary.library.encode(t or "")
        assert found[k].ids == want and found[k].agrees and found[k].decoded == vocabulary.library.decode(want), t
    again = decode_documents(made.withColumnRenamed("decoded", "before"), default_model())
    assert all(r.decoded == r.before for r in again.collect())
    assert encode_documents(docs.limit(0), default_model()).count() == 0
    whole = encode_documents(docs, default_model(), check="texts")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, made.collect()))
    assert [r.decoded for r in decode_documents(spark.createDataFrame([(None,), ([],)], "ids array<long>"), default_model()).collect()] == ["", ""]


def test_piece_query(spark, sf, vocabulary):
    from tidemark.llm.pieces import op13_piece_codec

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op13_piece_codec(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = vocabulary.library.encode(texts[r.doc_id])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (len(ids), sha(",".join(map(str, ids))), sha(vocabulary.library.decode(ids)), True)


def test_a_library_that_differs_counts(vocabulary, monkeypatch):
    from tidemark.llm import pieces

    monkeypatch.setattr(vocabulary, "rank", vocabulary.rank.copy())
    vocabulary.rank[:-1] = vocabulary.rank[:-1].max() - vocabulary.rank[:-1]  # the wrong order of merges
    texts = ["a", "international understanding", "", "b understanding"]
    for check in ("units", "texts"):
        monkeypatch.setattr(vocabulary, "known", pieces.Known())
        for _ in range(2):
            ids, column, agrees = pieces._checked(vocabulary, [*texts, *texts], check)  # repeated units are remembered
            assert column.to_pylist() == ids == vocabulary.library.encode([*texts, *texts]) and agrees == [True, False, True, False] * 2
        assert len(vocabulary.known.units) == 4


def test_remembered_units_change_nothing(vocabulary, texts, monkeypatch):
    from tidemark.llm import pieces

    want = vocabulary.library.encode(texts)
    monkeypatch.setattr(pieces, "KNOWN_UNITS", 50)
    monkeypatch.setattr(vocabulary, "known", pieces.Known())
    for at in (0, 100, 0, 200, 0):
        ids, column, agrees = pieces._checked(vocabulary, texts[at:], "units")
        assert ids == column.to_pylist() == want[at:] and all(agrees)
    assert len(vocabulary.known.units) == 50
