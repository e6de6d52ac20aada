import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from podlens.llm.arrow_text import Words, cached, covered, slices, text_buffers
from podlens.llm.blobs import pack, pack_plain, unpack, unpack_plain
from podlens.llm.fm_index import FMIndex
from podlens.llm.fingerprints import code_points, gram_hashes, winnow
from podlens.llm.packing import WordEncoder, hilbert
from podlens.llm.queries import tokenizer_path

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\x1c .|", max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_runs_of_other_than_white_space(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    for first, last in slices(offsets, 16):
        bounds = offsets[first : last + 1]
        found = Words(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        own = found.data.tobytes()
        split = [own[a:b].decode() for a, b in zip(found.starts, found.ends)]
        assert split == [w for text in texts[first:last] for w in brute.words(text)]
        assert found.counts.tolist() == [len(brute.words(text)) for text in texts[first:last]]
        hashes = found.hashes().tolist()
        assert len(set(zip(split, hashes))) == len(set(split)) == len(set(hashes))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(deadline=None)
def test_blobs_give_back_what_they_hold(values):
    ordered = np.array(sorted(values), np.uint64)
    assert (unpack(pack(ordered), len(values)) == ordered).all()
    plain = np.array(values, np.uint64)
    assert (unpack_plain(pack_plain(plain), len(values), np.uint64) == plain).all()


def test_windows_cover_their_words():
    assert covered(np.array([1, 2]), 3, 7).tolist() == [False, True, True, True, True, False, False]


@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=6), st.integers(1, 13))
@settings(max_examples=150, deadline=None)
def test_matching_statistics(sequences, depth):
    """An index of the first half answers for all sequences as a search in plain lists does."""
    half = sequences[: len(sequences) // 2 + 1]
    text = np.array([x for s in half for x in [*s, 0]])
    index = FMIndex(text)
    queries = np.array([x for s in sequences for x in [*s, 0]])
    ends = np.cumsum([len(s) + 1 for s in sequences]) - 1
    starts = ends - [len(s) for s in sequences]
    lengths, rows = index.matching_statistics(queries, starts, ends, depth)
    known = {tuple(s[i : i + k]) for s in half for k in range(depth + 1) for i in range(len(s) - k + 1)}
    for sequence, start in zip(sequences, starts):
        for i in range(len(sequence)):
            best = max(k for k in range(depth + 1) if i + k <= len(sequence) and tuple(sequence[i : i + k]) in known)
            assert lengths[start + i] == best
            at = index.order[rows[start + i]]
            assert text[at : at + best].tolist() == sequence[i : i + best]


@given(st.text(alphabet="abc", max_size=60), st.integers(1, 6), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_winnowing_takes_the_rightmost_smallest(text, gram, window):
    hashes = gram_hashes(code_points(text.encode()), gram)
    assert winnow(hashes, window).tolist() == brute.winnow(hashes.tolist(), window)


def test_hilbert_neighbours_differ_by_one_step():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    place = hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


ODD_WORDS = "don't. it's!! we'll, x<|endoftext|>. <|ENDOFTEXT|> a'.s 'S a_b__ é́. İ. ß! ﬁn. 12. a1. -- a--b-- “x”. ½. x². 漢字。 "


@given(st.lists(st.one_of(st.sampled_from(ODD_WORDS.split()), st.text(max_size=6)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_word_by_word_encoding_is_exact(words):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tokenizer = cached("test tokenizer", lambda: Tokenizer.from_file(path))
    encoder = cached("test encoder", lambda: WordEncoder(path))
    text = " ".join(words).encode("utf-8", "ignore")
    found = np.frombuffer(encoder.encode([text])[0], "<u2").tolist()
    assert found == tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_every_plain_letter_is_encoded_as_in_a_whole_text():
    encoder = WordEncoder(tokenizer_path())
    for number in range(0x41, 0x260):
        for text in (chr(number), f"a{chr(number)}b", f"{chr(number)}E x"):
            whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist() == whole, hex(number)


def test_context_keys():
    from podlens.llm.lm_scoring import DEPTH, END, Stream

    texts = [b"", b"Ab c", b"", b"  longer words than the depth ", b"x"]
    offsets = np.concatenate([[0], np.cumsum([len(text) for text in texts])])
    stream = Stream(np.frombuffer(b"".join(texts), np.uint8), offsets)
    expected = []
    for a, b in zip(stream.first, stream.first[1:]):
        own = bytes([END] * DEPTH) + bytes(stream.bytes[a:b])
        expected += [int.from_bytes(own[i + DEPTH : i + DEPTH + 1] + own[i : i + DEPTH], "little") for i in range(b - a)]
    assert stream.keys().dtype == np.uint64 and stream.keys().tolist() == expected
    assert len(Stream(np.zeros(0, np.uint8), np.zeros(1, np.int64)).keys()) == 0
