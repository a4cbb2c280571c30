"""GIF, byte-level BPE, license scans."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessella.llm import bpe, gif, license


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
@pytest.mark.parametrize("n", [0, 1, 2, 300, 6000, 40_000])
def test_lzw_round_trip(alphabet, n):
    rng = random.Random(n)
    data = bytes(rng.choice(alphabet) for _ in range(n))
    assert gif.lzw_decode(gif.lzw_encode(data), 8, n).tobytes() == data


def _slow_decode(data: bytes, bits: int) -> bytes:
    """LZW as written in the format's description, a code at a time."""
    clear, out, at, width = 1 << bits, bytearray(), 0, bits + 1
    table: list[bytes] = []
    last = None
    number = int.from_bytes(data, "little")
    while at + width <= 8 * len(data):
        code = number >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
        elif code == clear + 1:
            break
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return bytes(out)


def test_streams_are_what_any_decoder_reads():
    rng = random.Random(4)
    for n in (1, 500, 9000):
        data = bytes(rng.choice(b"abcab ") for _ in range(n))
        assert _slow_decode(gif.lzw_encode(data), 8) == data


def test_full_tables_without_clear_codes():
    """A stream may go on at 12 bits after its table is full."""
    rng = random.Random(8)
    codes = [256] + [rng.randrange(256) for _ in range(9000)] + [257]
    widths = [9] + [int(gif._WIDTHS[8][min(k, 4096)]) for k in range(len(codes) - 1)]
    data = gif.pack_codes(np.array(codes, np.uint32), np.array(widths))
    assert gif.lzw_decode(data, 8, 9000).tobytes() == bytes(codes[1:-1]) == _slow_decode(data, 8)


def _gif(frames, w=4, h=4, colours=4):
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0x81, 0, 0), palette.tobytes()]
    for f in frames:
        if "gce" in f:
            out.append(b"\x21\xf9\x04" + struct.pack("<BHB", *f["gce"]) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", *f["box"], f.get("flags", 0)) + f.get("palette", b"") + b"\x02")
        stream = gif.lzw_encode(bytes(f["samples"]), 2)
        out.append(bytes([len(stream)]) + stream + b"\0")
    return b"".join(out) + b"\x3b"


def test_disposal_transparency_interlace_and_palettes():
    red, green = [1] * 16, [0, 2, 2, 0]
    data = _gif([{"box": (0, 0, 4, 4), "samples": red}, {"gce": (3 << 2 | 1, 7, 0), "box": (1, 1, 2, 2), "samples": green}, {"gce": (2 << 2, 5, 0), "box": (0, 0, 1, 1), "samples": [3]}, {"gce": (1, 1, 3), "box": (3, 3, 1, 1), "samples": [3]}])
    got = gif.read_gif(data)
    assert got.error is None and [f.delay_cs for f in got.frames] == [0, 7, 5, 1]
    shown = [c for _, c in gif.canvases(got)]
    assert tuple(shown[1][1, 1]) == (255, 0, 0, 255) and tuple(shown[1][1, 2]) == (0, 255, 0, 255)  # transparent keeps red
    assert tuple(shown[2][1, 2]) == (255, 0, 0, 255) and tuple(shown[2][0, 0]) == (0, 0, 255, 255)  # restored to what was before
    assert tuple(shown[3][0, 0]) == (0, 0, 0, 0) and tuple(shown[3][3, 3]) == (255, 0, 0, 255)  # cleared to nothing
    assert gif.histogram(shown[3])[48] == 15
    for (_, a), (_, c) in zip(gif.histograms(got), gif.canvases(got), strict=True):
        assert a.tolist() == gif.histogram(c).tolist()
    rows = [0, 1, 2, 3]
    stored = [r for k in (0, 2, 1, 3) for r in [rows[k]] * 4]  # of four rows the passes take 0, 2, 1 and 3
    assert gif.read_gif(_gif([{"box": (0, 0, 4, 4), "flags": 0x40, "samples": stored}])).frames[0].samples.reshape(4, 4)[:, 0].tolist() == rows
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    assert tuple(next(gif.canvases(gif.read_gif(_gif([{"box": (0, 0, 4, 4), "flags": 0x81, "palette": own, "samples": [1] * 16}]))))[1][0, 0]) == (8, 8, 8, 255)


@pytest.mark.parametrize("cut", [0, 5, 12, 20, 30, -3])
def test_broken_media(cut):
    whole = gif.payload_to_gif(b"abc ".ljust(192))
    got = gif.read_gif(whole[:cut])
    assert got.error and not got.frames


def test_op1_contract(odd, empty):
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    rows = gif.digest(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and r.error is None
    assert gif.digest(empty).count() == 0
    with_null = gif.decode_media(gif.encode_texts(odd).withColumn("media", F.when(F.col("doc_id") > 3, F.col("media"))))
    assert with_null.where("doc_id <= 3 and gif_frames is null").count() == 5 - 1


def test_bpe_as_tiktoken(odd, empty):
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = bpe.digest(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.digest(empty).count() == 0
    rng = random.Random(1)
    e = bpe.Encoder(public.path("byte_bpe_50k.json"), public.PATTERN)
    odd_texts = ["".join(chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0x10000, 0x10FFFF), 32, 10, 39, 0x88F, 0x11DE0])) for _ in range(30)) for _ in range(300)]
    ids, limits = e.encode(odd_texts)
    assert [ids[a:b].tolist() for a, b in zip(limits[:-1], limits[1:], strict=True)] == [encoding.encode_ordinary(t) for t in odd_texts]


def test_split_characters(odd):
    path = public.path("byte_bpe_50k.json")
    rows = bpe.encode_texts(odd.where("doc_id = 9"), path, public.PATTERN)
    tokens = bpe.token_rows(rows, path).orderBy("token_no").collect()
    text = odd.where("doc_id = 9").first().text
    assert any(t.splits_char for t in tokens) and tokens[-1].byte_end == len(text.encode())
    for t in tokens:
        assert len(text.encode()[: t.byte_start].decode(errors="ignore")) == t.char_start
    stream = bpe.StreamDecoder(path)
    assert "".join(stream.feed([t.token_id]) for t in tokens) + stream.feed([], final=True) == text
    assert bpe.StreamDecoder(path).feed([tokens[[t.splits_char for t in tokens].index(True)].token_id], final=True)


def _slow_scan(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in license.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_op7_contract(spark, docs, odd, empty, sf):
    some = docs(["All Rights Reserved.", "cc BY, cc-by cc", "This work is licensed under the GNU General Public License, version 3.", "the gnu general", "ALL RIGHTS\nRESERVED all rights reserved", "É cc by", None])
    for rows in (some, odd, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = {r.doc_id: r.text for r in rows.collect()}
        for r in license.digest(rows).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _slow_scan(texts[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    got = {r.doc_id: (r.labels, r.score) for r in license.digest(some).collect()}
    # a template's share of its longest form: 3 of 13 words, 12 of 23
    assert got[0] == ("reserved,rights-reserved", pytest.approx(0.5 + 1.5 / 13)) and got[2] == ("gpl,gpl-3.0", pytest.approx(0.5 + 6 / 23)) and got[1] == ("cc-by", 0.5) and got[3] == ("", 0.0)
    assert license.digest(empty).count() == 0


def test_template_markup():
    a = license.compile_template("t", "one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> four <<var;words=1-2>> end")
    match = lambda t: a.match([license.hash_word(w) for w in t.split()])
    assert [match(t) for t in ("one four x end", "one two four x y end", "one two three four x end more", "one three four x end", "one four end", "one four x y z end", "one")] == [4, 6, 6, 0, 0, 0, 0]
    for bad in ("<<beginOptional>>x", "x <<endOptional>>", "<<beginOptional>>x<<endOptional>>"):
        with pytest.raises(ValueError):
            license.compile_template("bad", bad)
    mit = license.TEMPLATES["mit"].replace("<<var;words=1-12>>", "Jane Doe").replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    scanner = license.Scanner(license.TEMPLATES, {})
    raw = np.frombuffer(("intro " + mit + " tail").encode(), np.uint8)
    assert [f[1] for f in scanner.scan(raw, np.array([0, len(raw)]))[1][0]].count("mit") >= 1
    changed = np.frombuffer(mit.replace("sublicense", "relicense").encode(), np.uint8)
    assert not [f for f in scanner.scan(changed, np.array([0, len(changed)]))[1][0] if f[1] == "mit"]


#: Notices as projects print them, with the labels of the templates that they must get.
NOTICES = {
    "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.": "gpl-3.0-notice",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2.0-notice",
    "is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "lgpl-2.1-notice",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl-2.0-notice",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless': "apache-2.0",
    "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n\n\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.": "apache-2.0-text",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
    "Licensed under the Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.": "unlicense",
}


def test_notices_as_they_are_printed(docs):
    texts = [f"{before}{text}{after}" for text in NOTICES for before, after in (("", ""), ("Some words first. ", "\nMore words."))]
    want = [label for label in NOTICES.values() for _ in range(2)]
    rows = license.digest(docs(texts)).orderBy("doc_id").collect()
    own = lambda r: set(filter(None, r.labels.split(","))) - set(license.PHRASES.values())
    assert [own(r) for r in rows] == [{w} for w in want] and all(0.5 < r.score <= 1 for r in rows)
    # one word of the mandatory wording changed: nothing but the phrases is left
    changed = [t.replace("redistribute", "share").replace("obtain", "get").replace("Attribution", "Contribution").replace("unencumbered", "open").replace("Definitions", "Terms").replace("Version 2.0 (", "Version 3.0 (") for t in NOTICES]
    assert [own(r) for r in license.digest(docs(changed)).collect()] == [set()] * len(changed)


def test_bsd_conditions_tell_the_licenses_apart(docs):
    filled = lambda label: " ".join(license.TEMPLATES[label].replace("<<var;words=1-12>>", "Jane Doe").replace("<<beginOptional>>", "").replace("<<endOptional>>", "").split())
    texts = [filled("bsd-2-clause"), filled("bsd-3-clause"), filled("isc").replace("<<var;words=1-8>>", "the author"), filled("bsd-3-clause").replace("endorse", "praise")]
    got = [set(r.labels.split(",")) for r in license.digest(docs(texts)).orderBy("doc_id").collect()]
    assert got == [{"bsd-2-clause"}, {"bsd-3-clause"}, {"isc"}, {""}]


def test_license_template_that_begins_with_any_words():
    raw = np.frombuffer(b"One two alpha beta. alpha beta", np.uint8)
    at = np.array([0, 20, len(raw)])
    for begin, want in (("<<var;words=0-1>>", [(1, 4), (2, 4)]), ("<<var;words=1-2>>", [(0, 4), (1, 4)]), ("<<beginOptional>><<var;words=2-2>><<endOptional>>", [(0, 4), (2, 4)])):
        found = license.Scanner({"t": begin + "alpha beta"}, {}).scan(raw, at)[1]
        assert [x[2:] for x in found[0]] == want and [x[2:] for x in found[1]] == ([] if "1-2" in begin else [(0, 2)])


def test_screens_of_any_size():
    """A screen far larger than its frames costs nothing; frames far apart are an error."""
    pixel = lambda left, top, **more: gif.Frame(left, top, 1, 1, np.array([7], np.uint8), gif.GREYS, **more)
    small = gif.read_gif(gif.write_gif([pixel(3, 5), pixel(0, 0, transparent=9)], 65535, 65535, gif.GREYS))
    counts = [h.sum() for _, h in gif.histograms(small)]
    assert small.error is None and counts == [1, 2] and [c.shape for _, c in gif.canvases(small)] == [(6, 4, 4)] * 2
    far = gif.read_gif(gif.write_gif([pixel(0, 0), pixel(65534, 65534)], 65535, 65535, gif.GREYS))
    assert [h for _, h in gif.histograms(far)] == [None, None] and "65535 x 65535" in far.error


def test_payload_frames_use_the_format(docs):
    """Long payloads make several frames; transparency, disposal and palettes change what is shown, not the samples."""
    rng = random.Random(1)
    payload = bytes(rng.choice(b"ab \xff\x00 ") for _ in range(gif.ROW * (2 * gif.ROWS + 9)))
    read = gif.read_gif(gif.payload_to_gif(payload))
    assert [(f.disposal, f.transparent, f.height) for f in read.frames] == [(1, 32, 256), (2, 32, 256), (3, 32, 9)] and read.error is None
    assert b"".join(f.samples.tobytes() for f in read.frames) == payload and not np.array_equal(read.frames[0].palette, read.frames[1].palette)
    grey = lambda b: 21 * (b >> 6)
    one, two, three = (np.frombuffer(payload, np.uint8)[k : k + gif.ROW * gif.ROWS].astype(int) for k in range(0, len(payload), gif.ROW * gif.ROWS))
    first = np.where(one == 32, -1, grey(one))
    second = np.where(two == 32, first, grey(255 - two))
    third = np.full(len(one), -1)  # the second frame cleared the canvas
    third[: len(three)] = np.where(three == 32, -1, grey(three))
    for (_, got), want in zip(gif.histograms(read), (first, second, third), strict=True):
        assert got.tolist() == np.bincount(want[want >= 0], minlength=64).tolist()


def test_ranks_of_both_files_agree():
    """The table that the encoder reads has the tokens and ranks of the contract's file, all of them."""
    path = public.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    order = sorted(ranks, key=ranks.get)
    data, at = bpe.decode_ids(np.array([ranks[t] for t in order]), public.path("byte_bpe_50k.json"))
    assert len(order) > 50_000 and [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == order
