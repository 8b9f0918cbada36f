import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factloom.llm import packing
from tests.llm.conftest import HARD

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=60, deadline=None)
def test_bound_and_best_fit_enclose_the_optimum(sizes):
    lengths = np.array(sizes, np.int64)

    def fits(k, rest, room):  # whether the pieces go into k bins
        if not rest:
            return True
        return any(fits(k, rest[1:], (*room[:i], room[i] - rest[0], *room[i + 1 :])) for i in range(k) if room[i] >= rest[0] and room.index(room[i]) == i)

    best = next((k for k in range(len(sizes) + 1) if fits(k, sorted(sizes, reverse=True), (20,) * k)), 0)
    assert packing.lower_bound(lengths, 20) <= best <= packing.best_fit_decreasing(lengths, 20)[2]


def test_best_fit_is_gapless():
    lengths = np.random.default_rng(0).integers(1, 1024, 3000)
    bins, offsets, made = packing.best_fit_decreasing(lengths)
    frame = pd.DataFrame({"b": bins, "o": offsets, "n": lengths}).sort_values(["b", "o"])
    assert made == frame.b.nunique() and (frame.groupby("b").n.cumsum() - frame.n == frame.o).all() and frame.groupby("b").n.sum().max() <= 1024


def test_tokens_equal_the_tokenizer_file():
    own = Tokenizer.from_file(PATHS[0])
    encode = packing.tokenizer(*PATHS)
    rng = random.Random(3)
    letters = " \n\t\x1c\x85\u2003\u3000abé1٣日's.,!<|>"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(24))) for _ in range(3000)]
    for text in [t or "" for _, t in HARD] + odd + ["It's 12,345 déjà-vu\n\n  tab\t🎉", "<|endoftext|> x<|endoftext|>", "　 a b\r\n", "a" + " " * 1_000_000 + "b"]:
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids
    assert encode("<|endoftext|>").tolist() == [50256]


def test_pack_places_every_token_once(hard, docs_of):
    got = packing.pack(hard, *PATHS, group_pieces=4).toPandas()
    encode = packing.tokenizer(*PATHS)
    texts = {i: encode(t or "").tobytes() + b"\x02\0\0\0" for i, t in HARD if i is not None}
    for r in got[got.doc_id.notna()].itertuples():
        ids = texts[int(r.doc_id)][4 * r.start : 4 * (r.start + r.length)]
        assert zlib.crc32(ids) == r.ids_crc32 and len(ids) == 4 * r.length
    assert got.length.sum() == sum(len(encode(t or "")) + 1 for _, t in HARD)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.length.cumsum() - own.length == own.offset).all() and own.length.sum() <= 1024
    for _, own in got[got.doc_id == 10].groupby("doc_id"):
        own = own.sort_values("piece")
        assert (own.start.diff().dropna() == own.length.shift().dropna()).all() and (own.length[1:] == 1024).all()
    assert packing.pack(docs_of([]), *PATHS).count() == 0


def test_certificate_holds(spark, docs_of):
    rows = [(k, "word " * (37 * k % 900)) for k in range(300)]
    got = packing.pack(docs_of(rows), *PATHS, group_pieces=50).toPandas()
    assert (got.made >= got.lower_bound).all()
    assert got.sequence_id.nunique() <= 1.05 * packing.lower_bound(got.length.to_numpy())


def test_groups_exchange_until_all_meet_the_bound(docs_of):
    rows = [(k, "word " * (1 + 37 * k % 90)) for k in range(600)]
    got = packing.pack(docs_of(rows), *PATHS, group_pieces=120).toPandas()
    assert got.all_bound.max() == packing.lower_bound(got.length.to_numpy())
    one_round = packing.pack(docs_of(rows), *PATHS, group_pieces=120, rounds=0).toPandas()
    assert got.all_bound.max() <= got.sequence_id.nunique() < one_round.sequence_id.nunique()
