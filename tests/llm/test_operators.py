import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.llm import gru_lm, licenses, lm_scoring, media, packing, url_rules, webp
from netloom.llm._text import utf8

import pyarrow as pa

ENCODER = packing.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_chunked_ids_are_the_texts_ids(texts):
    ids, first = ENCODER.batch(*utf8(pa.array(texts, pa.large_string())))
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == ENCODER.encode([text])[0]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20))
def test_plan_uses_every_piece_once_and_fits(counts):
    histogram = np.zeros(65, int)
    for n, c in counts.items():
        histogram[n] = c
    plan = packing.make_plan(histogram, 64)
    used = np.zeros(65, int)
    for pattern, repeats in plan:
        assert sum(pattern) <= 64 and repeats > 0
        for n in pattern:
            used[n] += repeats
    assert (used == histogram).all()


def test_cut_pieces():
    assert packing.cut(2048, 2048) == [(0, 2048)]
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_payload_round_trip(raw):
    payload = media.to_payload(raw)
    assert len(payload) % 64 == 0 and payload and payload.startswith(raw)
    assert media.read_back(media.store(payload), len(payload)) == payload


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (13, 7), (40, 33)])
def test_pixels_round_trip(shape):
    pixels = np.random.default_rng(1).integers(0, 2**32, shape, dtype=np.uint32)
    assert (webp.decode(webp.encode(pixels))[0] == pixels).all()


def coded(width, height, head, symbols, cache_bits=0):
    """An image whose five codes are: green of 2 symbols, others of one; ``head`` is written before them."""
    out = webp.BitWriter()
    for value, n in [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), *head]:
        out.put(value, n)
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    out.put(0, 1)
    a, b = symbols
    lengths = np.zeros(280 + ((1 << cache_bits) if cache_bits else 0), np.int64)
    lengths[[a, b]] = 1
    webp.write_code(out, lengths)
    for value in (0, 0, 255, 0):
        out.put(0b101, 3)
        out.put(value, 8)
    return out


def finish(out):
    return webp.decode_vp8l(out.value.to_bytes((out.size + 7) // 8 + 1, "little"))


def test_back_reference_copies_the_row_above():
    # literal 9, then a copy of length 4 (prefix 3) at distance code 1: the pixel above, here one to the left
    out = coded(1, 5, [(0, 1)], (9, 256 + 3))
    out.put(0, 1)
    out.put(1, 1)
    assert (finish(out) == np.uint32(0xFF000900)).all()


def test_colour_cache_gives_the_pixel_again():
    slot = ((0xFF000900 * webp.CACHE_FACTOR) & 0xFFFFFFFF) >> 30
    out = coded(3, 1, [(0, 1)], (9, 280 + slot), cache_bits=2)
    for bit in (0, 1, 1):
        out.put(bit, 1)
    assert (finish(out) == np.uint32(0xFF000900)).all()


def test_inverse_transforms():
    green = webp.joined(np.array([[[1, 10, 250, 255]]]))
    assert webp.channels(webp.undo_subtract_green(green)).tolist() == [[[11, 10, 4, 255]]]
    table = np.array([0xFF000001, 0xFF000002], np.uint32)
    packed = np.array([[0b10110 << 8]], np.uint32)
    assert webp.undo_palette(packed, table, 5).tolist() == [[0xFF000000 + 1 + x for x in (0, 1, 1, 0, 1)]]
    same = np.array([[0xFF102030]], np.uint32)
    assert (webp.undo_cross_color(same, np.zeros((1, 1), np.uint32), 2) == same).all()


def plain_predictor(pixels, modes, size_bits):
    """Pixel by pixel, channel by channel, as the format describes it."""
    height, width = pixels.shape
    out = [[None] * width for _ in range(height)]
    split = lambda p: [(int(p) >> s) & 255 for s in (24, 16, 8, 0)]
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clip = lambda v: max(0, min(255, v))
    for y in range(height):
        for x in range(width):
            if x == y == 0:
                guess = [255, 0, 0, 0]
            elif y == 0:
                guess = out[0][x - 1]
            elif x == 0:
                guess = out[y - 1][0]
            else:
                left, top, corner = out[y][x - 1], out[y - 1][x], out[y - 1][x - 1]
                right = out[y - 1][x + 1] if x + 1 < width else out[y][0]
                mode = (int(modes[y >> size_bits, x >> size_bits]) >> 8) & 15
                if mode == 11:
                    estimate = [a + b - c for a, b, c in zip(left, top, corner)]
                    guess = left if sum(abs(e - a) for e, a in zip(estimate, left)) < sum(abs(e - b) for e, b in zip(estimate, top)) else top
                else:
                    guess = {
                        0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top),
                        8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)),
                        12: [clip(a + b - c) for a, b, c in zip(left, top, corner)], 13: [clip(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner)],
                    }[mode]
            out[y][x] = [(a + b) & 255 for a, b in zip(split(pixels[y, x]), guess)]
    return np.array([[(p[0] << 24) | (p[1] << 16) | (p[2] << 8) | p[3] for p in row] for row in out], np.uint32)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor_mode_equals_a_plain_one(mode):
    rng = np.random.default_rng(mode)
    for shape in ((1, 1), (1, 7), (6, 1), (9, 11)):
        pixels = rng.integers(0, 2**32, shape, dtype=np.uint32)
        tiles = np.full((-(-shape[0] >> 2), -(-shape[1] >> 2)), mode << 8, np.uint32)
        undone = webp.undo_predictor(pixels, tiles, 2)
        assert (undone == plain_predictor(pixels, tiles, 2)).all()
        assert (webp.apply_predictor(undone, tiles, 2) == pixels).all()


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_files_with_every_feature_round_trip(data):
    rng = np.random.default_rng(data.draw(st.integers(0, 2**32)))
    height, width = data.draw(st.integers(1, 20)), data.draw(st.integers(1, 30))
    colours = rng.integers(0, 2**32, data.draw(st.sampled_from([1, 2, 5, 16, 17, 200])), dtype=np.uint32)
    pixels = rng.choice(colours, (height, width))
    tile = lambda w: tuple(-(-n >> 2) for n in (height, w))
    ways = {
        "predictor": (webp.PREDICTOR, 2, rng.integers(0, 14, tile(width)).astype(np.uint32) << np.uint32(8)),
        "cross": (webp.CROSS_COLOR, 2, rng.integers(0, 2**24, tile(width), dtype=np.uint32)),
        "green": (webp.SUBTRACT_GREEN,),
        "palette": (webp.PALETTE, np.unique(pixels)),
    }
    # a palette changes the width, so it comes last
    names = data.draw(st.permutations(["predictor", "cross", "green"]))[: data.draw(st.integers(0, 3))]
    transforms = [ways[n] for n in names] or ([ways["palette"]] if data.draw(st.booleans()) else [])
    moved = pixels
    for t in transforms:
        moved = webp.transformed(moved, t)
    copies = webp.find_copies(moved.ravel(), data.draw(st.sampled_from([1, 3, 8])))
    back, _ = webp.decode(webp.encode(pixels, tuple(transforms), data.draw(st.sampled_from([0, 1, 6, 11])), copies))
    assert (back == pixels).all()


def test_every_text_of_a_table_goes_through_the_whole_decoder(spark, monkeypatch):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    seen, written = collections.Counter(), []
    symbols = webp.Symbols

    def watched(tokens, cache_bits):
        written.append(np.bincount(tokens[:, 0], minlength=3))
        return symbols(tokens, cache_bits)

    monkeypatch.setattr(webp, "Symbols", watched)
    for text in [*texts, "abababab" * 40]:
        payload = media.to_payload(text.encode())
        stored = media.store(payload)
        assert media.read_back(stored, len(payload)) == payload
        undo = webp.parse_vp8l(webp.chunk_of(stored)[0])[1]
        kinds = [k for k, *_ in undo]
        few = len(set(payload)) <= media.PALETTE_SIZE
        assert kinds == ([webp.PALETTE] if few else [webp.PREDICTOR, webp.CROSS_COLOR])
        seen["palette"] += few
        if not few:
            assert written[-1][2] > 0, "cached pixels"
            seen["copies"] += bool(written[-1][1])
            seen.update(((undo[0][1] >> np.uint32(8)) & np.uint32(15)).ravel().tolist())
    assert seen["palette"] and seen["copies"] > 10 and {*range(1, 14)} <= {*seen}, seen


def test_predictors_of_green_equal_the_general_ones():
    rng = np.random.default_rng(5)
    images = []
    for height, width in ((1, 1), (1, 9), (7, 1), (9, 11), (33, 20), (4, 64)):
        tiles = rng.integers(0, 16, (-(-height >> 2), -(-width >> 2))).astype(np.uint32) << np.uint32(8)
        images.append((rng.integers(0, 256, (height, width), dtype=np.uint32) << np.uint32(8), tiles, 2))
    for (pixels, tiles, bits), undone in zip(images, webp.undo_green_predictors(images), strict=True):
        plain = plain_predictor(pixels, np.where(tiles >> np.uint32(8) > 13, np.uint32(0), tiles), bits)
        assert (undone == plain).all()
        assert (webp.apply_predictor(undone, tiles, bits) == pixels).all()


def test_cached_pixels_equal_those_read_one_by_one(monkeypatch):
    rng = np.random.default_rng(6)
    for bits in (1, 3, 8, 11):
        for colours in (3, 40, 900):
            pixels = rng.choice(rng.integers(0, 2**32, colours, dtype=np.uint32), (30, 31))
            data = webp.encode(pixels, (), bits, 2)
            assert (webp.decode(data)[0] == pixels).all()
            with monkeypatch.context() as m:
                m.setattr(webp, "pixels_by_arrays", lambda b, g, w, n, c=0: webp.pixels_by_symbols(b, [g], None, 0, w, n // w, c).ravel())
                assert (webp.decode(data)[0] == pixels).all()


def test_media_digests_of_a_table_equal_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = sorted(tuple(r)[:5] for r in media.media_digests(docs).collect())
    plain = []
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        plain.append((r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert found == sorted(plain)


def test_long_payload_is_several_files():
    payload = np.random.default_rng(0).integers(97, 123, media.IMAGE_BYTES + 64, dtype=np.uint8).tobytes()
    stored = media.store(payload)
    assert stored.count(b"WEBPVP8L") == 2 and media.read_back(stored, len(payload)) == payload


def test_images_become_pixels(spark):
    pixels = np.arange(12, dtype=np.uint32).reshape(3, 4) * 12345
    rows = [(1, bytearray(webp.encode(pixels))), (2, None), (3, bytearray(b"not an image"))]
    out = {r["id"]: r for r in media.decode_images(spark.createDataFrame(rows, "id bigint, media binary"), "id", "media").collect()}
    assert (out[1]["width"], out[1]["height"]) == (4, 3) and (np.frombuffer(out[1]["pixels"], "<u4").reshape(3, 4) == pixels).all()
    assert out[2]["error"] and out[3]["error"] and out[2]["pixels"] is None


@pytest.mark.parametrize("data", [b"", b"RIFF", b"RIFF\x20\0\0\0WEBPVP8L\x05\0\0\0\x2f\0\0\0\0aaaaaaa", b"x" * 50])
def test_broken_images_raise(data):
    with pytest.raises(webp.WebpError):
        webp.decode(data)


SIDE = 8


def test_language_model_gradient():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in gru_lm.start_weights(np.arange(SIDE * SIDE, 0, -1.0), 50.0, SIDE).items()}
    w = {k: v + 0.05 * rng.normal(size=v.shape) for k, v in w.items()}
    words = rng.integers(0, SIDE * SIDE + 1, (4, 3))
    words[3, 2] = -1
    fresh = np.zeros((4, 3), bool)
    fresh[0], fresh[2, 1] = True, True
    h = np.zeros((3, gru_lm.UNITS))
    _, g, _ = gru_lm.gradients(w, h, words, fresh)
    for name, place in (("state", (2, 5)), ("state", (1, 60)), ("input", (int(words[0, 0]), 3)), ("class_w", (4, 2))):
        step = 1e-5
        lossy = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][place] += sign * step
            lossy.append(gru_lm.gradients(moved, h, words, fresh)[0])
        assert abs((lossy[0] - lossy[1]) / (2 * step) - g[name][place]) < 1e-6


def test_language_model_shares_sum_to_one():
    w = gru_lm.start_weights(np.arange(SIDE * SIDE, 0, -1.0), 50.0, SIDE)
    h = np.random.default_rng(1).normal(size=(1, gru_lm.UNITS)).astype(np.float32)
    each = [np.exp(gru_lm.output_log(w, h, np.array([k]))[0]) for k in range(SIDE * SIDE + 1)]
    assert abs(sum(each) - 1) < 1e-3


def test_documents_side_by_side_score_as_one_by_one():
    """A plain scorer: one word after the other, whole softmaxes."""
    rng = np.random.default_rng(5)
    w = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in gru_lm.start_weights(np.arange(SIDE * SIDE, 0, -1.0), 50.0, SIDE).items()}
    sizes = [1, 70, 3, 24, 25, 49]
    words = rng.integers(0, SIDE * SIDE + 1, sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)])
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    u = gru_lm.UNITS
    for i, got in enumerate(gru_lm.document_logs(w, words, first)):
        h, total = np.zeros(u), 0.0
        for word in words[first[i] : first[i + 1]]:
            group = word // SIDE
            total += np.log(soft(h @ w["class_w"] + w["class_b"])[group])
            if group < SIDE:
                total += np.log(soft(h @ w["word_w"][group] + w["word_b"][group])[word % SIDE])
            x, s = w["input"][word].astype(float), h @ w["state"]
            z, r = (1 / (1 + np.exp(-(x[k : k + u] + s[k : k + u]))) for k in (0, u))
            h = (1 - z) * np.tanh(x[2 * u :] + r * s[2 * u :]) + z * h
        assert abs(got - total) <= 1e-4 * abs(total)


def test_weights_travel_in_parts():
    w = gru_lm.start_weights(np.arange(SIDE * SIDE, 0, -1.0), 50.0, SIDE)
    back = gru_lm.from_parts(gru_lm.to_parts(w), w)
    assert all((back[k] == w[k]).all() for k in w)


def test_every_text_gives_a_segment():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 900, 60)
    first = np.concatenate([[0], np.cumsum(sizes)])
    keys = rng.integers(0, 2**60, first[-1]).astype(np.uint64)
    start, end, hashed = lm_scoring.chosen_segments(keys, first, 0.25)
    assert set(np.searchsorted(first, start, side="right") - 1) == set(range(60))
    assert (end - start <= lm_scoring.SEGMENT).all() and 0.2 < (end - start).sum() / first[-1] < 0.5
    whole = lm_scoring.chosen_segments(keys, first, 1.0)
    assert (whole[1] - whole[0]).sum() == first[-1]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.org/en/12?x#y", "https://example.org/es/1", "http://x.example.com/de/5", "http://x.example.com/fr/5", "http://example.net", "http://a.org", "http://notexample.org/es/1"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages).collect()}
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[4][2:] == ("example.org/es/", "block")
    assert got[5][2:] == ("com/de/", "block")
    assert got[6][2:] == ("com/fr/", "allow")
    assert got[8][1:3] == ("", None)
    assert got[9][2:] == ("org/", "allow")


def test_licences(spark):
    rows = [(1, "p/a/x.txt", "some words\nReleased under the MIT License."), (2, "p/a/LICENSE", "Licensed under the Apache License, Version 2.0.\nmore words that are not of it at all"), (3, "p/a/b/c/y.txt", "nothing"), (4, "q/z.txt", None), (5, None, "text"), (6, "p/a/x.txt", "some words\nReleased under the MIT License.")]
    rows += [(100 + i, f"r/{i}.txt", f"plain words number {i}") for i in range(40)]
    out = {r["file_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "file_id bigint, path string, text string")).collect()}
    assert len(out) == len(rows)
    assert (out[1]["license"], out[1]["origin"]) == (out[6]["license"], out[6]["origin"]) == ("MIT", "own")
    assert out[2]["license"] == "Apache-2.0"
    assert (out[3]["origin"], out[3]["licensed_by"]) == ("inherited", "p/a")
    assert out[4]["origin"] == out[5]["origin"] == out[100]["origin"] == "none"


def test_licence_beside_a_frequent_word(spark):
    rows = [(1, "p/x.txt", "Released under the MIT License only.")] + [(100 + i, f"r/{i}.txt", f"only plain words number {i} {('released', 'under', 'the', 'mit', 'license')[i % 5]}") for i in range(400)]
    out = {r["file_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "file_id bigint, path string, text string")).collect()}
    assert (out[1]["license"], out[1]["origin"]) == ("MIT", "own")
    assert out[100]["origin"] == "none"


def test_licence_headers_and_files(spark):
    apache = "#!/usr/bin/env python\n# Copyright 2019 The Authors. All Rights Reserved.\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     https://www.apache.org/licenses/LICENSE-2.0\n#\nimport os\nvalue = compute(first, second)\n"
    gpl = "/* hello.c\n *\n * This program is free software: you can redistribute it and/or modify it under\n * the terms of the GNU General Public License as published by the Free Software\n * Foundation, either version 3 of the License, or (at your option) any later version.\n */\nint main(void) { return run(everything, else_too); }\n"
    bsd = "Copyright (c) 2011, Jane Doe\n\nRedistribution and use in source and binary forms, with or without modification,\nare permitted provided that the following conditions are met:\n"
    mit = "MIT License\n\nCopyright (c) 2017 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files (the \"Software\"), to deal in\nthe Software without restriction, including without limitation the rights to\nuse, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of\nthe Software, and to permit persons to whom the Software is furnished to do so,\nsubject to the following conditions:\n\nmore of it follows\n"
    wanted = {
        1: ("This file is released under the MIT License.", "MIT"),
        2: ("Some code. Released under the MIT License by Jane Doe.", "MIT"),
        3: ("// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"),
        4: ("/* SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) */", "GPL-2.0"),
        5: (mit, "MIT"),
        6: (bsd, "BSD-3-Clause"),
        7: (gpl, "GPL-3.0"),
        8: (gpl.replace("General", "Affero General"), "AGPL-3.0"),
        9: ("GNU GENERAL PUBLIC LICENSE\nand what else there is in it", "GPL-1.0-or-later"),
        10: ("words before it\n# This work is licensed under the GNU General\n# Public License, version 3.\nwords after it", "GPL-3.0"),
        11: (apache, "Apache-2.0"),
        12: ("We talk of the GNU General Public License in passing here.", None),
    }
    rows = [(k, f"p{k}/x.txt", text) for k, (text, _) in wanted.items()] + [(100 + i, f"r/{i}.txt", f"plain words number {i} of the file by hand") for i in range(200)]
    out = {r["file_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "file_id bigint, path string, text string")).collect()}
    assert {k: out[k]["license"] for k in wanted} == {k: name for k, (_, name) in wanted.items()}
    assert all(out[k]["origin"] == "none" for k in out if k >= 100)


def test_the_network_is_trained_on_every_token():
    rng = np.random.default_rng(5)
    keys, first = rng.integers(0, 2**63, 5000).astype(np.uint64), np.array([0, 1, 900, 1500, 5000])
    start, end, _ = lm_scoring.chosen_segments(keys, first, lm_scoring.FIT_SHARE)
    assert start[0] == 0 and (start[1:] == end[:-1]).all() and end[-1] == len(keys)


def test_payloads_stored_and_read_together_equal_those_alone(monkeypatch):
    rng = np.random.default_rng(9)
    word = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in rng.integers(2, 9, 60)]
    texts = [b"", b"ab" * 300, bytes(range(256)) * 9, *(b" ".join(word[k] for k in rng.integers(0, 60, int(n))) for n in rng.integers(1, 2500, 30))]
    payloads = [media.to_payload(t) for t in texts]
    stored = media.store_all(payloads)
    assert stored == [media.store(p) for p in payloads]
    calls, together = [], webp.pixels_together
    monkeypatch.setattr(webp, "pixels_together", lambda images: calls.append(len(images)) or together(images))
    assert media.read_back_all(stored, [len(p) for p in payloads]) == payloads
    assert len(calls) == 1 and calls[0] > 25, "the pixels of all images are read in one walk"
    grey = np.frombuffer(payloads[2], np.uint8).reshape(-1, 64).astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
    ways = ((webp.CROSS_COLOR, 9, np.full((1, 1), 0xFF002020, np.uint32)), (webp.PREDICTOR, 4, webp.best_modes(grey, 4)))
    assert stored[2] == webp.encode(grey, ways, media.CACHE_BITS, media.COPY)
    for file, payload in zip(stored, payloads, strict=True):
        # read by itself
        assert ((webp.decode(file)[0] >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes()[: len(payload)] == payload


def test_copies_of_cached_pixels_read_together_equal_the_pixels():
    rng = np.random.default_rng(10)
    files, plain = [], []
    for bits in (0, 1, 4, 11):
        for colours in (3, 40, 200):
            row = rng.choice(rng.integers(0, 256, colours, dtype=np.uint32), 400)
            pixels = (np.concatenate([row, row[100:350], row, row[::-1]])[: 29 * 50].reshape(29, 50) << np.uint32(8)) | np.uint32(0xFF000000)
            plain.append(pixels)
            files.append(webp.encode(pixels, (), bits, 2))
    assert all((a == b).all() for a, b in zip(webp.decode_many(files), plain, strict=True))
    body = webp.chunk_of(files[5])[0]
    with pytest.raises(webp.WebpError):
        cut = body[: len(body) // 2]
        webp.decode_many([b"RIFF" + (12 + len(cut)).to_bytes(4, "little") + b"WEBPVP8L" + len(cut).to_bytes(4, "little") + cut])


def test_long_documents_take_few_windows_and_training_needs_no_loss(monkeypatch):
    rng = np.random.default_rng(4)
    w = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in gru_lm.start_weights(np.arange(SIDE * SIDE, 0, -1.0), 50.0, SIDE).items()}
    words = rng.integers(0, SIDE * SIDE + 1, 3000)
    first, calls, plain = np.array([0, 2900, 2990, 3000]), [], gru_lm.output_log
    monkeypatch.setattr(gru_lm, "output_log", lambda w, h, word: calls.append(len(word)) or plain(w, h, word))
    together = gru_lm.document_logs(w, words, first)
    assert len(calls) == 2 and sum(calls) == 3000, "a window a step of 24 words before"
    monkeypatch.setattr(gru_lm, "OUTPUTS", 1)
    assert np.allclose(together, gru_lm.document_logs(w, words, first), rtol=1e-4)
    text, fresh = words[:480].reshape(24, 20), np.zeros((24, 20), bool)
    h = np.zeros((20, gru_lm.UNITS), np.float32)
    (loss, g, _), (none, same, _) = (gru_lm.gradients(w, h, text, fresh, x) for x in (True, False))
    assert loss > 0 and none == 0 and all((g[k] == same[k]).all() for k in g)
