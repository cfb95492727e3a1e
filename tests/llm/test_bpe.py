"""Token ids against those of a library that merges pair by pair, and back to the bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken

from emulsia.llm import bpe

CUT = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def both(request):
    with open(public_tokenizers.path(request.param), "rb") as file:
        ours = bpe.Vocabulary(file.read())
    return ours, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.rank, special_tokens={})


def test_same_ids_as_merging(both):
    ours, theirs = both
    rng = random.Random(3)
    tokens = [t.decode(errors="ignore") for t in ours.rank]
    made = [
        lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(0, 60))),
        lambda: "".join(chr(rng.randrange(1, 0x3000)) for _ in range(rng.randint(0, 30))),
        lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 60))),
        lambda: "".join(rng.choice(" \n\t\r'.,sretlvd019") for _ in range(rng.randint(0, 60))),
        lambda: "".join(rng.choice(tokens) for _ in range(rng.randint(0, 8))),
        lambda: "".join(rng.choice(tokens).strip() for _ in range(rng.randint(0, 8))),
    ]
    for k in range(6000):
        text = made[k % len(made)]()
        ids = ours.encode(text, CUT)
        assert ids.tolist() == theirs.encode_ordinary(text), text
        assert b"".join(ours.decode(ids).to_pylist()) == text.encode()


def test_every_token_is_its_own_piece(both):
    ours, _ = both
    assert all(ours.piece(token) == [rank] for token, rank in ours.rank.items())


@pytest.mark.parametrize("letters", ["a", "abcdefghijklmnopqrstuvwxyz", " ", "ß", "!?", "가나다라"])
def test_one_very_long_piece(both, letters):
    ours, theirs = both
    rng = random.Random(5)
    text = "".join(rng.choice(letters) for _ in range(200_000))
    assert ours.encode(text, CUT).tolist() == theirs.encode_ordinary(text)


def test_tokens_that_no_merge_builds():
    """abc has no two parts in the vocabulary that BPE would leave side by side: it is found as a whole piece only."""
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"bcd", b"abcd", b"xyz"]
    import base64

    ours = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.rank, special_tokens={})
    for text in ("xyz", "xyzxyz", "abcd", "bcd", "abcdab", "aabb", " xyz", "abxyz"):
        assert ours.encode(text, CUT).tolist() == theirs.encode_ordinary(text)


def test_report_on_every_kind_of_row(spark, docs, rows, empty):
    path = public_tokenizers.path(bpe.RANKS)
    with open(path, "rb") as file:
        theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(file.read()).rank, special_tokens={})
    want = Counter()
    for r in rows:
        ids = theirs.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.report(docs).collect())) == want
    assert bpe.report(empty).count() == 0


def test_columns_stay_and_unknown_ids_decode_to_null(spark):
    path = public_tokenizers.path(bpe.RANKS)
    docs = spark.createDataFrame([(1, "a text", "x", 2), (2, None, None, None)], "id long, text string, IDS string, __raw int")
    coded = bpe.encode(docs, path)
    assert coded.columns == ["id", "text", "IDS", "__raw", "ids_"]
    back = {r["id"]: r for r in bpe.decode(coded, path, ids="ids_").collect()}
    assert bytes(back[1]["decoded"]) == b"a text" and bytes(back[2]["decoded"]) == b"" and back[1]["IDS"] == "x" and back[1]["__raw"] == 2
    odd = spark.createDataFrame([([5, 10**6],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, path).collect()] == [None, None, b""]
    more = spark.createDataFrame([([64, None],), ([64, 65],), ([-1],), (None,), ([66],)], "ids array<int>").coalesce(1)
    assert [r["decoded"] for r in bpe.decode(more, path).collect()] == [None, b"ab", None, None, b"c"]


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff62' AS STRING) AS text")
    got = bpe.report(docs).first()
    assert got["decoded_sha256"] == hashlib.sha256("a�b".encode()).hexdigest()
