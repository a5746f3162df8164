import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm import alignment as A
from scriptloom.llm import stretches as S

TEXTS = [
    "", " ", "  a", "a  b", "trailing ", "\n a b\t c d", "é è naïve çà", "<|endoftext|> <s> <0x41> x", "日本 語 text",
    "don't we'll 12 3.4", "a b c", "emoji 😀 here", "A" * 5000, "word " * 3000, "a▁b ▁", "x.\nThe end!\n\n- no",
    "a, b; c? d! e: f... (g) \"h\" i,j", "ﬁ ½ ×÷ a×b b÷ c", "nul \x00 x", "   ", "ends \n", "uń mark",
]


def spelt_a(i):
    return A._byte_level_bytes(S.byte_level(S.byte_level_path()).id_to_token(i))


def plain(rows):
    """The whole contract one text after the other."""
    tokenizer, pieces = S.byte_level(S.byte_level_path()), S.pieces(S.piece_path())
    spell = S.piece_bytes(S.piece_path())
    groups = []
    for doc_id, text in rows:
        found = []
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(map(spelt_a, a)) == whole == b"".join(spell[i] for i in b):
            i = j = p = q = 0
            own_a, own_b = [], []
            while i < len(a) or j < len(b):
                if p <= q and i < len(a) and not (p == q and own_a):
                    own_a.append(a[i])
                    p, i = p + len(spelt_a(a[i])), i + 1
                else:
                    own_b.append(b[j])
                    q, j = q + len(spell[b[j]]), j + 1
                if p == q and own_a and own_b:
                    found.append((own_a, own_b))
                    own_a, own_b = [], []
        groups.append((doc_id, found))
    counts = Counter((a[-1], b[-1]) for _, found in groups for a, b in found)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc_id, found in groups:
        links = [(a[-1], b[-1]) for a, b in found]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        out.append(
            (
                doc_id, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(links),
                sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links),
                hashlib.sha256(text.encode()).hexdigest() if found else "",
            )
        )
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def test_report_agrees_with_the_plain_version(docs, prose):
    rows = list(enumerate(TEXTS)) + [(100 + k, prose(k, 40)) for k in range(20)]
    rows += [(900, None), (None, "no id"), (3, "a  b"), (901, "Ünïcödé schön größe, ñandú. ciónes\nAß")]
    got = A.alignment_report(docs(rows, extra=True)).collect()
    want = plain(rows)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(1 for r in want if r[3]) > 30 and any(r[2] > r[3] for r in want)


def test_lists_of_groups(docs):
    row = A.align_tokens(docs([(1, "uń mark 日本")])).first()
    a, b = iter(row["a_ids"]), iter(row["b_ids"])
    spell = S.piece_bytes(S.piece_path())
    assert len(row["a_sizes"]) == len(row["b_sizes"])
    for n, m in zip(row["a_sizes"], row["b_sizes"]):
        assert b"".join(spelt_a(next(a)) for _ in range(n)) == b"".join(spell[next(b)] for _ in range(m))
    assert next(a, None) is None and next(b, None) is None


def test_empty_table(docs):
    assert A.alignment_report(docs([])).collect() == []


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_groups_lie_between_common_ends(left, right):
    a, b = np.cumsum(left), np.cumsum(right)
    last = min(a[-1], b[-1])
    a, b = np.append(a[a < last], last), np.append(b[b < last], last)
    in_a, in_b = A.overlap_groups(a, b)
    common = np.intersect1d(a, b)
    assert in_a.tolist() == np.searchsorted(common, a, "left").tolist()
    assert in_b.tolist() == np.searchsorted(common, b, "left").tolist()


def test_pointers_double_over_a_long_chain():
    n = 1 << 12  # tokens of two bytes, one side shifted by one: a single component
    a = np.append(np.arange(2, 2 * n, 2), 2 * n)
    b = np.append(np.arange(1, 2 * n, 2), 2 * n)
    in_a, in_b = A.overlap_groups(a, b)
    assert not in_a.any() and not in_b.any()


def test_the_bound_on_linked_pairs():
    assert 32_000 < A.most_links(S.byte_level_path(), S.piece_path()) < 1_000_000


ALPHABET = st.lists(
    st.sampled_from([*"abÉñß ,.!'\n\t 1-日×", "  ", " the", "ing", "▁", "ción"]), max_size=40
).map("".join)


@settings(deadline=None, max_examples=150)
@given(st.lists(ALPHABET, min_size=1, max_size=6))
def test_ids_are_those_of_whole_texts(texts):
    path, other = S.byte_level_path(), S.piece_path()
    ids, at, spelt = S.byte_level_ids(pa.array(texts), path)
    assert spelt.all()
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == S.byte_level(path).encode(text, add_special_tokens=False).ids
    ids, at, spelt = S.piece_ids(pa.array([" " + t if t else "" for t in texts]), other)
    for k, text in enumerate(texts):
        assert spelt[k] == ("▁" not in text)
        if spelt[k]:
            assert ids[at[k] : at[k + 1]].tolist() == S.pieces(other).encode(text)


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_equal_hashes_and_a_full_table(monkeypatch, most):
    monkeypatch.setattr(S.words, "span_hashes", lambda raw, starts, ends, fold: (ends - starts).astype(np.uint64) % 3)
    path = S.byte_level_path()
    monkeypatch.setattr(S, "byte_level_table", lambda p, t=S.StretchTable(S.byte_level_encode(path), most): t)
    for texts in (TEXTS[:8], TEXTS[8:], TEXTS[:8]):
        ids, at, _ = S.byte_level_ids(pa.array(texts), path)
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == S.byte_level(path).encode(text, add_special_tokens=False).ids
