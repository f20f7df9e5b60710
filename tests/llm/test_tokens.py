"""Token counts, token files and packing against the tokenizers library."""

from __future__ import annotations

import os
import random
import string
import zlib

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ownergraph.llm.bpe_count import PairMerger, token_counts
from ownergraph.llm.packing import RoomTree, cuts, first_fit_decreasing, pack
from ownergraph.llm.token_files import token_files
from ownergraph.llm.word_ids import WordIds

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def _odd_texts():
    draw = random.Random(4)
    out = ["", " ", "  a", "a \n b", "\n\na", "it's 'S I'll", "x<|endoftext|>y <|endoftext|>", "a\x1cb \x85", "x" * 400]
    out += ["".join(draw.choice(" \n\t.,'éaA1  \x1c-—ß́sσΣ½<|") for _ in range(draw.randint(1, 25))) for _ in range(1500)]
    return out + ["a" + chr(c) + " b" for c in range(0x2100) if not 0xD800 <= c < 0xE000]


def test_counts_equal_the_library_on_odd_texts():
    own, lib = PairMerger(BYTES), Tokenizer.from_file(BYTES)
    texts = _odd_texts()
    assert [own.count(t) for t in texts] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert own.count(None) == 0


def test_word_ids_equal_the_library_on_odd_texts(monkeypatch):
    from ownergraph.llm import word_ids

    monkeypatch.setattr(word_ids, "REMEMBER", 300)  # the table is dropped often
    own, lib = WordIds(WORDS), Tokenizer.from_file(WORDS)
    texts = _odd_texts()
    got = [x for i in range(0, len(texts), 100) for x in own.encode(texts[i : i + 100])]
    assert got == [own.pack(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_marks_after_letters_are_not_cut_off():
    own, lib = WordIds(WORDS), Tokenizer.from_file(WORDS)
    letters = [chr(c) for c in range(0x11000) if chr(c).isalpha() and not 0xD800 <= c < 0xE000]
    odd = [x for x in letters if not x.lower()[-1].isalpha()] + ["\u0130"]
    texts = ["T\u00dcRK\u0130YE B\u00dcY\u00dcK M\u0130LLET MECL\u0130S\u0130.", "BAKIRK\u00d6Y BELED\u0130YES\u0130, 2024"]
    texts += [f"ab{x}. {x}, {x}b. {x}" for x in odd]
    texts += [" ".join(f"a{x}. b{x}," for x in letters[i : i + 50]) for i in range(0, len(letters), 50)]
    got = [x for i in range(0, len(texts), 40) for x in own.encode(texts[i : i + 40])]
    want = [own.pack(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_special_strings_match_in_their_own_case_only():
    own, lib = WordIds(WORDS), Tokenizer.from_file(WORDS)
    texts = ["A <|ENDOFTEXT|> b", "x<|EndOfText|>Y", "<|endoftext|>Word <|StartOfText|>", "UP<|startoftext|>UP <|"]
    got = own.encode(texts)
    assert got == [own.pack(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.pack([49407]) not in got[0] + got[1]


def test_token_counts_on_odd_rows(odd_docs, no_docs):
    lib = Tokenizer.from_file(BYTES)
    got = token_counts(odd_docs, BYTES).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts(no_docs, BYTES).count() == 0


def _ids(text, end):
    return np.array([*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(odd_docs, no_docs):
    got = token_files(odd_docs, WORDS, end_id=2).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    want = sorted((str(r.doc_id), zlib.crc32(_ids(r.text, 2).tobytes())) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    assert token_files(no_docs, WORDS, end_id=2).count() == 0


def test_room_tree_is_first_fit():
    draw = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        lengths = draw.integers(1, 101, n)
        sequence, offset = first_fit_decreasing(lengths, 100)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            at = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if at == len(room):
                room.append(100)
            assert (sequence[i], offset[i]) == (at, 100 - room[at])
            room[at] -= lengths[i]
    assert RoomTree(0, 5).first(5) == 0


@pytest.mark.parametrize("room", [16, 2048])
def test_packing_holds_every_id_once(odd_docs, no_docs, room):
    got = pack(odd_docs, WORDS, 1, room).toPandas()
    ids = [(r.doc_id, _ids(r.text, 1)) for r in odd_docs.collect()]
    assert got.length.sum() == sum(len(x) for _, x in ids)
    want = sorted((str(d), a, k, zlib.crc32(x[a : a + k].tobytes()), len(x)) for d, x in ids for a, k in zip(np.cumsum([0, *cuts(len(x), room)]).tolist(), cuts(len(x), room)))
    own = got.astype({"doc_id": "Int64"})
    key = lambda d: "None" if d is None or d != d else str(int(d))
    assert sorted((key(None if d is own.doc_id.dtype.na_value else d), a, k, c, n) for d, a, k, c, n in zip(own.doc_id, own.start, own.length, own.ids_crc32, own.doc_tokens)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= room and g.offset.tolist() == np.cumsum([0, *g.length[:-1]]).tolist()
    assert pack(no_docs, WORDS, 1, room).count() == 0


def test_packing_wastes_little(llm_spark):
    draw = random.Random(1)
    rows = [(i, " ".join("a" for _ in range(int(draw.expovariate(1 / 700))))) for i in range(1500)]
    got = pack(llm_spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 1).toPandas()
    used = got.groupby("sequence_id").length.sum()
    assert (2048 - used).sum() < 0.01 * used.sum()


def test_odd_words_are_given_to_the_library_together():
    import public_tokenizers

    from ownergraph.llm.word_ids import WordIds

    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    plain, calls = words.lib, []

    class Counted:
        def encode(self, *args, **kwargs):
            calls.append(args)
            return plain.encode(*args, **kwargs)

        def __getattr__(self, name):
            return getattr(plain, name)

    words.lib = Counted()
    texts = ["a-b 12 x_y \u200b <|endoftext|>! na\u00efve's", "12 caf\u00e9, 3.5 \u0301 \ufb01x9 <|x|> \x00", "", None]
    got = words.encode(texts)
    assert got == [words.pack(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert len(calls) <= 4  # the odd words, the words of letters, two marks


def test_words_of_plain_letters_go_to_the_model_alone():
    words = WordIds(WORDS)
    plain, calls = words.lib, []

    class Counted:
        def encode(self, *args, **kwargs):
            calls.append(args)
            return plain.encode(*args, **kwargs)

        def __getattr__(self, name):
            return getattr(plain, name)

    words.lib = Counted()
    texts = [" ".join(f"{a}{b}{a}{b}th" for a in string.ascii_letters for b in "aeZ"), "The END. the\tend,\x0b\x1cthe\x85end\x0c\r\n", " ", None]
    assert words.encode(texts[:1]) == [words.pack(plain.encode(texts[0], add_special_tokens=False).ids)] and not calls
    assert words.encode(texts) == [words.pack(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_words_before_any_punctuation_share_their_core():
    words, lib = WordIds(WORDS), Tokenizer.from_file(WORDS)
    cores = ["word", "été", "İ", "don't", "x9", "ΣΣ", "UP<|", "日本", "a_b", "क़"]
    texts = [" ".join(c + t for c in cores) for t in [*string.punctuation, "!!!", ",###", "'s", "''", ".<|", "́.", "<|endoftext|>."]]
    assert words.encode(texts) == [words.pack(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    known = dict(words.known)
    words.encode(["word" + t for t in string.punctuation])
    assert words.known == known
