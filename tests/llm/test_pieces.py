import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from frames import WILD, WILD_IDS, documents, empty, ids, wild
from sentencepiece import sentencepiece_model_pb2 as layout
from tessera.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "abehinorst   .,!▁<s>ÀéßΣİ漢²ﬁ①㌔Ａ　́가\x1c\x85\t\n019_​😀"


def random_texts(count, longest=60):
    draw = random.Random(11)
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(longest))) for _ in range(count)] + [
        "", " ", "  ", "   a", "a  ", "\n", " \n \n", "▁", "▁ ▁", "<s></s><unk>", "<0x41>", "a\0b", "x" * 300, "ab " * 200]


def changed(folder, name, **settings):
    """A copy of the model file with other settings."""
    with open(PATH, "rb") as file:
        model = layout.ModelProto.FromString(file.read())
    for key, value in settings.items():
        setattr(model.trainer_spec if key == "byte_fallback" else model.normalizer_spec, key, value)
    if not model.trainer_spec.byte_fallback:
        for piece in model.pieces:
            piece.type = 3 if piece.type == 6 else piece.type  # no longer bytes, only names
    path = f"{folder}/{name}.model"
    with open(path, "wb") as file:
        file.write(model.SerializeToString())
    return path


def compiled_map(rule):
    spec = layout.NormalizerSpec.FromString(
        sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    return spec.precompiled_charsmap


@pytest.fixture(scope="module", params=["given", "nfkc", "squeezed", "folded", "no bytes", "no prefix"])
def model_path(request, tmp_path_factory):
    settings = {
        "given": {},
        "nfkc": {"precompiled_charsmap": compiled_map("nmt_nfkc")},
        "squeezed": {"precompiled_charsmap": compiled_map("nfkc"), "remove_extra_whitespaces": True},
        "folded": {"precompiled_charsmap": compiled_map("nmt_nfkc_cf"), "remove_extra_whitespaces": True},
        "no bytes": {"byte_fallback": False},
        "no prefix": {"add_dummy_prefix": False},
    }[request.param]
    return changed(tmp_path_factory.mktemp("models"), request.param, **settings)


def test_ids_spans_and_text_equal_the_library(model_path):
    library, own = sentencepiece.SentencePieceProcessor(model_file=model_path), pieces.PieceModel(model_path)
    for text in random_texts(1500):
        listed = library.encode(text, return_type="proto").pieces
        found = own.encode(text)
        assert [i for i, _, _ in found] == [p.id for p in listed], repr(text)
        assert [(b, e) for _, b, e in found] == [(p.begin, p.end) for p in listed], repr(text)
        assert own.decode([i for i, _, _ in found]) == library.decode([p.id for p in listed]), repr(text)
        n, numbers, widths, decoded = own.digest(text)
        assert (n, numbers, decoded) == (
            len(listed), ",".join(str(p.id) for p in listed), library.decode([p.id for p in listed])), repr(text)
        assert widths == ",".join(str(e - b) for _, b, e in found), repr(text)


def test_any_ids_decode_as_in_the_library(model_path):
    library, own = sentencepiece.SentencePieceProcessor(model_file=model_path), pieces.PieceModel(model_path)
    draw = random.Random(4)
    for _ in range(1500):
        numbers = [draw.choice((draw.randrange(300), draw.randrange(len(own.texts)))) for _ in range(draw.randrange(12))]
        assert own.decode(numbers) == library.decode(numbers), numbers


def test_map_normalises_as_the_library():
    for rule in ("nmt_nfkc", "nfkc_cf"):
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True,
                                                        remove_extra_whitespaces=True)
        settings = layout.NormalizerSpec.FromString(library.serialized_normalizer_spec())
        settings.add_dummy_prefix = settings.escape_whitespaces = settings.remove_extra_whitespaces = True
        own = pieces.Normalizer(settings)
        for text in random_texts(800):
            assert own(text)[0] == library.normalize(text), repr(text)


def test_every_text_of_the_table(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in pieces.encoded_digests(docs, PATH).collect():
        found = library.encode(texts[row.doc_id] or "")
        assert row.n_tokens == len(found)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(found).encode()).hexdigest()


def test_odd_rows_and_round_trip(spark):
    rows = pieces.encoded_digests(wild(spark), PATH).collect()
    assert ids(rows) == WILD_IDS
    nothing = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in rows if r.doc_id in (2, 3)} == {(0, *[nothing] * 3)}
    encoded = pieces.encode(wild(spark), PATH)
    spans = {r.doc_id: r.pieces for r in encoded.collect()}
    texts = {r.doc_id: r.text for r in pieces.decode(encoded, PATH).collect()}
    for doc_id, text, *_ in WILD:
        if doc_id is not None:
            assert texts[doc_id] == (text or "")
            raw = (text or "").encode()
            assert b"".join(raw[p.begin:p.end] for p in spans[doc_id]) == raw
    assert pieces.encoded_digests(empty(spark), PATH).count() == 0
