import struct
from hashlib import sha256
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
import sentencepiece

from terrapath.llm import sentencepiece_offsets as so
from terrapath.llm.queries import QUERIES, model_path

TEXTS = [None, "", " ", "  two  blanks ", "naïve Straße\n\tTab", "日本語 and 🙂 emoji", "a" * 5000, "\u0000zero", "▁ escaped ▁", "<s> </s> <unk> <0x0A>", "é combining"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def test_ids_spans_and_decoding_match_the_library(lib):
    e = so.Encoder(Path(model_path()).read_bytes())
    for t in TEXTS:
        ids = e.ids(t)
        assert ids.tolist() == lib.encode(t or "", add_eos=True)
        assert e.decode(ids) == lib.decode(ids.tolist())
        raw = (t or "").encode()
        starts, stops = e.spans(t, ids)
        assert b"".join(raw[a:z] for a, z in zip(starts, stops, strict=True)) == raw
        pieces = lib.encode(t or "", return_type="proto").pieces
        assert [raw[a:z].decode(errors="replace") for a, z in zip(starts, stops, strict=True)][:-1] == [p.surface for p in pieces] or any(p.piece.startswith("<0x") for p in pieces)


def test_operator_round_trip(spark, lib):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, None, "y")], "doc_id long, text string, ids string")
    enc = so.encode(df, model_path())
    assert sorted((r.doc_id, r.ids) for r in enc.collect()) == sorted([(i, lib.encode(t or "", add_eos=True)) for i, t in enumerate(TEXTS)] + [(0, lib.encode("", add_eos=True))])
    back = {r.doc_id: r.text for r in so.decode(enc, model_path()).collect()}
    assert back == {i: lib.decode(lib.encode(t or "")) for i, t in enumerate(TEXTS)}
    assert so.encode(df.limit(0), model_path()).count() == 0


def library_spans(lib, text):
    """(start, stop) source bytes of each of the library's pieces. It gives a code point that byte pieces share to the
    last of them; those are dealt one byte each."""
    out, shared = [], 0
    for p in lib.encode(text, return_type="proto").pieces:
        if lib.is_byte(p.id):
            out.append((p.begin + shared, p.begin + shared + 1))
            shared = 0 if p.end > p.begin else shared + 1
        else:
            out.append((p.begin, p.end))
    return [*out, (len(text.encode()),) * 2]


def test_query_against_library(spark, lib):
    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_eos=True)
        spans = np.array(library_spans(lib, r.text or ""), "<i8")
        digest = sha256(spans[:, 0].tobytes() + spans[:, 1].tobytes()).hexdigest()
        want[r.doc_id] = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(lib.decode(ids).encode()).hexdigest(), len((r.text or "").encode()), digest)
    got = QUERIES["op10_sentencepiece_offsets"](spark, d).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_bytes, r.spans_sha256) for r in got} == want


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_a_real_character_map_against_the_library(rule):
    """The library's own compiled maps: normalised text, and where each of its code points comes from."""
    from sentencepiece import sentencepiece_model_pb2

    n = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(n.serialized_model_proto())
    assert len(proto.normalizer_spec.precompiled_charsmap) > 100_000
    own = so.Normalizer(proto.normalizer_spec)
    texts = [t for t in TEXTS if t is not None and "\0" not in t] + ["ＫＡＤＯＫＡＷＡ   ABC ①½ ﬁ", "ﷺ ㍿ ｶﾞ é Å", " \u3000 ", "İSTANBUL ẞ ǅ", "a\u200bb\ufeffc"]
    for t in texts:
        want, offsets = n.normalize(t, with_offsets=True)
        got, align = own(t)
        assert got.decode() == want, t
        raw, place = t.encode(), 0
        for c, at in zip(want, offsets, strict=False):
            assert len(raw[: align[place]].decode(errors="ignore")) == at, (t, c)
            place += len(c.encode())


def trie(pairs: dict[bytes, bytes]) -> bytes:
    """A compiled character map by brute force: a double array with a block of 256 units per node."""
    pool, values = b"", {}
    for k, v in pairs.items():
        values[k] = len(pool)
        pool += v + b"\0"
    nodes = sorted({k[:i] for k in pairs for i in range(len(k) + 1)}, key=lambda x: (len(x), x))
    block = {n: 256 * (i + 1) for i, n in enumerate(nodes)}
    where = {b"": 0}
    for n in nodes[1:]:
        where[n] = block[n[:-1]] ^ n[-1]
    units = [0x80000000] * (256 * (len(nodes) + 2))
    for n in nodes:
        offset = where[n] ^ block[n]
        wide = offset >= 1 << 21
        units[where[n]] = (offset >> 8 << 10 | 1 << 9 if wide else offset << 10) | (n in values) << 8 | (n[-1] if n else 0)
        if n in values:
            units[block[n]] = 0x80000000 | values[n]
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + pool


def normalizer(pairs, **kw):
    base = {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}
    return so.Normalizer(SimpleNamespace(precompiled_charsmap=trie(pairs), **(base | kw)))


def test_longest_prefix_and_alignment():
    n = normalizer({"ﬁ".encode(): b"fi", b"ab": b"x", b"abc": b"yy", "　".encode(): b" "})
    out, align = n("abcab ﬁ")
    assert out == "▁yyx▁fi".encode()
    # each normalised byte points to where its source starts; one past the end is the end of the text
    assert align.tolist() == [0, 0, 0, 0, 0, 3, 5, 5, 5, 6, 6, 9]
    out, align = n("  ab　　c ")
    assert out == "▁x▁c".encode()
    assert align[-1] == len("  ab　　c".encode())


def test_plain_and_general_paths_agree():
    spec = {"add_dummy_prefix": True, "remove_extra_whitespaces": False, "escape_whitespaces": True}
    plain, general = so.Normalizer(SimpleNamespace(precompiled_charsmap=b"", **spec)), normalizer({b"\xff": b""}, remove_extra_whitespaces=False)
    for t in TEXTS[1:]:
        a, b = plain(t), general(t)
        assert a[0] == b[0] and np.array_equal(a[1], b[1])
