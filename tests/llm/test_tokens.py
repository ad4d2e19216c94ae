import random
import zlib

import numpy as np
import pytest

import public_tokenizers
from plumbline.llm import pieces, rans

BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "\n", "a  b\n\n c\t d\x85e\xa0f", "don't we'll 'x <|endoftext|> ½x² x́y abcΣ a,b;c d.e-f 12ab ab12", " é  \x1cq\x1f z​", "日本語 テキスト  end  ", "A\x00B ퟿z", "the the the.", "x" * 3000]


def test_chunks_give_the_library_ids():
    tokenizer = rans.Tokenizer(BPE)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab'’ \n\t.,é日1²_-!") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    flat, sizes = tokenizer.encode(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert tokenizer.library.encode(text, add_special_tokens=False).ids == ids.tolist(), text


def test_cache_thins_out_and_still_gives_the_library_ids():
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(BPE), random.Random(4)
    tokenizer = rans.Tokenizer(BPE)
    tokenizer.cache.limit = 60
    for _ in range(60):
        texts = [" ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(3000)}"]) for _ in range(40)) for _ in range(3)]
        flat, sizes = tokenizer.encode(texts)
        for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
            assert plain.encode(text, add_special_tokens=False).ids == ids.tolist()
        assert len(tokenizer.cache.index) <= 60 + 3 * 41 and " the" in tokenizer.cache.index


def test_added_tokens_keep_their_ids():
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(BPE), random.Random(3)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext|", *TEXTS]
    texts += ["".join(rng.choice(["<|endoftext|>", " ", "  ", "\n", "ab", "'s", "é", "1", "<|", "|>"]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    flat, sizes = rans.Tokenizer(BPE).encode(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert plain.encode(text, add_special_tokens=False).ids == ids.tolist(), text
    assert flat[:4].tolist() == [64, 220, 50256, 275]


@pytest.mark.parametrize("n", [1, 7, 8, 4095, 4096, 4097, 20_000])
def test_rans_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % rans.VOCABULARY
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=rans.VOCABULARY)))
    words, states, first, crc = coder.encode(ids)
    assert (coder.decode(words, states, first, crc, n) == ids).all()
    if n > 5000:
        blocks = len(crc)
        assert len(words) * 8 / n < 16 and blocks == -(-n // rans.BLOCK)
        b = blocks - 1  # the last block on its own, from its checkpoint
        rest = n - b * rans.BLOCK
        assert (coder.decode(words, states[b:], first[b:], crc[b:], rest) == ids[b * rans.BLOCK:]).all()


def test_damage_is_found():
    ids = np.arange(5000) % 100
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=rans.VOCABULARY)))
    words, states, first, crc = coder.encode(ids)
    broken = bytearray(words)
    broken[40] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken), states, first, crc, 5000)


def test_frequency_table():
    for counts in (np.zeros(rans.VOCABULARY, np.int64), np.arange(rans.VOCABULARY), np.eye(1, rans.VOCABULARY, 3, dtype=np.int64)[0] * 10**12):
        f = rans.frequencies(counts)
        assert f.min() >= 1 and f.sum() == 1 << rans.SCALE_BITS


def test_token_files(docs, spark, tmp_path):
    table = docs(*[(20 - i, t) for i, t in enumerate(TEXTS)], (None, "null id"), (20, None), (20, ""), extra=["n", "ids", "counts"])
    path = str(tmp_path / "files")
    rans.write_token_files(table, BPE, path, files=3)
    rows = rans.read_token_files(spark, path).collect()
    library = rans.Tokenizer(BPE).library
    want = sorted([(-1, "null id"), *[(20 - i, t) for i, t in enumerate(TEXTS)], (20, ""), (20, "")], key=lambda x: x[0])
    ids = {i: [] for i, _ in want}
    for i, t in want:
        ids[i].append([*library.encode(t, add_special_tokens=False).ids, 0])
    rows.sort(key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in rows] == [i for i, _ in want]
    at = 0
    for r in rows:
        crcs = {zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[-1 if r.doc_id is None else r.doc_id]}
        assert r.start == at and r.ids_crc32 in crcs
        at += r.n_tokens


def test_token_files_of_an_empty_table(docs, spark, tmp_path):
    rans.write_token_files(docs(), BPE, str(tmp_path / "none"), files=2)
    assert rans.read_token_files(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture(scope="module")
def coder():
    vocabulary = pieces.load_vocabulary(pieces.default_model())
    return vocabulary, pieces.build_trie(vocabulary.pieces)


def test_trie_holds_exactly_the_pieces(coder):
    vocabulary, trie = coder

    def find(word):
        state = 0
        for c in word:
            to = trie.base[state] + c + 1
            if trie.check[to] != state:
                return -1
            state = to
        return trie.value[state]

    assert all(find(p) == i or vocabulary.pieces[find(p)] == p for i, p in enumerate(vocabulary.pieces) if p)
    assert find("▁zzzzqqq".encode()) == -1 and find(b"\xff\xfe") == -1


def test_pieces_score_as_well_as_the_library(coder):
    """The library, given the same pieces and scores as a unigram model, finds no better segmentation."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as schema

    vocabulary, trie = coder
    model = schema.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = schema.TrainerSpec.UNIGRAM
    for i, p in enumerate(model.pieces):
        if vocabulary.pieces[i] is not None:
            p.score, p.type = float(vocabulary.scores[i]), schema.ModelProto.SentencePiece.NORMAL
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("thean ioué\n日1") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    encoder, decoder = pieces.Encoder(vocabulary, trie), pieces.Decoder(vocabulary)
    flat, sizes = encoder.encode(texts)
    same = 0
    cost = lambda ids: sum(float(np.float32(vocabulary.scores[i])) if vocabulary.pieces[i] is not None else 0.0 for i in ids)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert decoder.decode(ids) == text
        other = library.encode(text)
        same += other == ids.tolist()
        assert cost(ids.tolist()) >= cost(other) - 0.01 * max(1, len(other))
    assert same > 0.9 * len(texts)


def test_single_and_grouped_solvers_agree(coder):
    encoder = pieces.Encoder(*coder)
    words = [w.encode() for w in ("▁the", "▁thx", "▁añb", "▁日本")]
    for w in words:
        assert encoder._together([w, w], len(w)) == [encoder._single(w)] * 2


def test_encode_and_decode_tables(docs):
    table = docs(*TEXTS, None, "a ▁ mark", "repeat", (12, "repeat"), extra=["piece_ids", "n_pieces"])
    encoded = pieces.encode_pieces(table, pieces.default_model())
    rows = encoded.collect()
    texts = [*TEXTS, None, "a ▁ mark", "repeat", "repeat"]
    assert len(rows) == len(texts) and all(r.round_trip or "▁" in (texts[r.doc_id] or "") for r in rows)
    assert {r.n_pieces for r in rows if not texts[r.doc_id]} == {0}
    decoded = {r.doc_id: r.text for r in pieces.decode_pieces(encoded, pieces.default_model()).collect()}
    assert decoded[3] == TEXTS[3] and decoded[11] == "a   mark"
    assert pieces.encode_pieces(docs(), pieces.default_model()).count() == 0
