import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.sentencepieces import CharacterMap, SentencePieces, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return SentencePieces(f.read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(both, text):
    ours, theirs = both
    got = ours.encode(text)
    want = theirs.encode(text, add_bos=True, add_eos=True)
    assert got.ids.tolist() == want, repr(text)
    assert sum(got.sizes) == len(text.encode())
    assert ours.decode(want) == theirs.decode(want)


CASES = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\t x", "▁", "▁a b", "a▁ b", "a\0b", "é", "ｆｕｌｌ", "日本語 テキスト", "😀 x", "<s>", "<0x0A>", "<unk>", "12345", "x" * 5000, "ab " * 3000, "‍"]


@pytest.mark.parametrize("text", CASES)
def test_cases(both, text):
    same(both, text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(" \n▁abcdeé<>0x1", max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_corpus(both, spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for r in rows:
        same(both, r["text"])


def test_character_map_longest_prefix_and_alignment():
    """A hand-made double array with the keys 'a' -> 'x' and 'ab' -> 'yz'."""
    texts = b"x\0yz\0"
    units = [0] * 512
    units[0] = 0x80 << 10  # root: its children lie around 0x80
    a = 0x80 ^ ord("a")
    units[a] = (0x100 ^ a) << 10 | 1 << 8 | ord("a")  # leaf bit set: its own value is at the node's offset
    base = 0x100
    units[base] = 0 | 1 << 31
    b = base ^ ord("b")
    units[b] = (0x1C0 ^ b) << 10 | 1 << 8 | ord("b")
    units[0x1C0] = 2 | 1 << 31
    blob = (len(units) * 4).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + texts
    found = CharacterMap(blob)
    assert found.longest(b"ac", 0) == (1, b"x")
    assert found.longest(b"abc", 0) == (2, b"yz")
    assert found.longest(b"ca", 0) is None
    with open(PATH, "rb") as f:
        codec = SentencePieces(f.read())
    codec.map, codec.plain = found, False
    line, size = codec.normalise("ab ac")
    assert (line, size) == ("▁yz▁xc", [0, 2, 0, 1, 1, 1])


def test_operator_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "p"), (None, "a b", None), (1, None, "p")], "doc_id long, text string, _pieces string")
    got = encode_pieces(df, PATH, fields=("ids", "begins", "ends", "decoded", "n_bytes")).collect()
    assert [r["_pieces"] for r in got] == ["p", None, "p"]
    assert got[0]["ids"] == [1, 2] and got[0]["decoded"] == ""
    assert got[1]["decoded"] == "a b" and got[1]["n_bytes"] == 3 and got[1]["begins"][1] == 0
    assert encode_pieces(df.limit(0), PATH).count() == 0
