import gzip
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from merlake.llm import chat, common, licenses, url_filter, warc

from .helpers import edge_docs, empty_docs, prose

# ---------------------------------------------------------------- urls


def _judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_url_rules(spark):
    rng = random.Random(1)
    labels, steps = ["a", "b", "com", "x-y", "com2"], ["", "en", "e", "en/x", "é"]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = {(host(rng.randint(1, 3)), "/" + rng.choice(steps) + rng.choice(["", "/"])): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{host(rng.randint(1, 5))}/{rng.choice(steps)}{rng.choice(['', '/', '/z', '?q=/en', '#/en/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "://", "https://A.COM/En", "http://com", "http://com?x://y/", "http://u@a.com:80/en/", "http://a..com/en", urls[0], urls[0], "http://" + ".".join(["a"] * 300) + ".com/en/"]
    pages = spark.createDataFrame([(i if i % 50 else None, u, "c", "c", "c", "c") for i, u in enumerate(urls)], "page_id long, url string, rule string, key string, range string, host string")
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block"), rules[0]], "host string, path string, verdict string")
    for n in (4, 23):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(str, (tuple(r) for r in url_filter.judge(pages, table, default="block").collect())))
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == sorted(str((i if i % 50 else None, *_judge(u, rules, "block"))) for i, u in enumerate(urls))
    none = url_filter.judge(pages, table.limit(0)).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")} and len(none) == len(urls)
    assert url_filter.judge(pages.limit(0), table).count() == 0


def test_many_hosts_with_one_path(spark, monkeypatch):
    """Their keys are the same below a shared domain: swept once, joined back in parts."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000), F.lit(".com/")).alias("url"))
    table = spark.createDataFrame([("com", "/", "block"), ("h7.com", "/", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, table).collect()}
    seven = {i for i in range(3000) if i % 3 and i % 1000 == 7}
    assert got == {i: ("h7.com/", "allow") if i in seven else ("com/", "block") for i in range(3000)}


# ---------------------------------------------------------------- licences


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    return licenses.train([prose(rng, rng.randint(3, 40)) for _ in range(200)] + ["The work of the author in this part was free for all.", "Use of the form is not limited.", "Rights and duties are public."])


def test_licence_statements(spark, model):
    rng = random.Random(3)
    rows, want = [], {}
    for family, statements in licenses.TEMPLATES.items():
        for s in statements:
            i = len(rows)
            rows.append((i, f"{prose(rng, 30)}\n{s}\n{prose(rng, 12)}"))
            want[i] = family
    clean = [prose(rng, 300), "The license plate of the car was lost.", "General public opinion of the version was mixed.", "Copyright is a right.", "Permission to enter was granted."]
    for t in clean:
        want[len(rows)] = ""
        rows.append((len(rows), t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    right = sum(got[i].families == f for i, f in want.items())
    assert right >= len(want) - 1 and all(got[i].families == "" for i in range(len(rows) - len(clean), len(rows)))
    assert all((r.n_licensed > 0) == (r.families != "") == (r.probability is not None) for r in got.values())
    spans = licenses.scan_paragraphs(docs, model).collect()
    assert {r.paragraph for r in spans} == {0, 1} or {r.paragraph for r in spans} == {1}
    edges = edge_docs(spark).union(edge_docs(spark).where("doc_id = 1").withColumn("text", F.lit("x\nAll rights reserved.")).select(*edge_docs(spark).columns))
    own = licenses.scan(edges, model)
    assert own.count() == edges.count() and own.where("families <> ''").count() == 1
    assert licenses.scan(empty_docs(spark), model).count() == 0
    assert licenses.fit(docs, sample_docs=10).classes == model.classes and licenses.fit(docs.limit(0)).weights


MIT = """MIT License

Copyright (c) 2020 Some Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_wrapped_licence_texts(spark, model):
    rng = random.Random(21)
    plain = "\n".join(prose(rng, 12) for _ in range(5))
    texts = {
        "mit": [MIT, MIT.replace("\n", "\r\n"), plain + "\n" + MIT + "\n" + plain, "\n".join(MIT.split("\n")[4:7]).replace(" ", "\n")],
        "bsd": [BSD, "/*\n" + "\n".join(" * " + x for x in BSD.split("\n")) + "\n */"],
        "gpl-3.0": [GPL, "\n".join("# " + x for x in GPL.split("\n"))],
        "bsd,mit": [MIT + "\n\n\n" + BSD, BSD.split(":")[0] + ".\n" + MIT.split("\n\n")[2]],
        "": [plain, "\n" * 20_000, plain + "\n" + "\n".join(rng.sample(MIT.split(), 40))],
    }
    want = [(f, t) for f, own in texts.items() for t in own]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(want)], "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(docs, model).select("doc_id", "families", "n_licensed", "n_paragraphs").collect())
    assert got == [(i, f, len(f.split(",")) if f else 0, t.count("\n") + 1) for i, (f, t) in enumerate(want)]


#: Wordings that aren't among the templates, with the family that they name.
UNSEEN = [
    ("mit", "Distributed under the terms of the MIT License; see the file LICENSE."),
    ("mit", "The code is released under the MIT license."),
    ("apache-2.0", "This project is licensed under the Apache License, Version 2.0, a copy of which is enclosed."),
    ("gpl-3.0", "This manual is licensed under the GNU General Public License, version 3, or any later one."),
    ("gpl-2.0", "The driver is licensed under the GNU General Public License, version 2."),
    ("bsd", "Our library is licensed under the BSD 3-Clause License."),
    ("mpl-2.0", "All files are licensed under the Mozilla Public License, version 2.0, unless stated."),
    ("cc-by-4.0", "Text of this page is licensed under CC BY 4.0 by its authors."),
    ("cc-by-sa-4.0", "Articles are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "The data set is released under CC0 1.0 Universal by the museum."),
    ("lgpl", "Linked parts are licensed under the GNU Lesser General Public License."),
    ("reserved", "Copyright 2021 by the publisher. All rights reserved worldwide."),
    ("", "You need a license to drive a car, and a public road under it."),
    ("", "The general public was free to use the version of the work on the table."),
    ("", "He was released under the condition that he works in the public library."),
    ("", "The university reserved all rooms on the right."),
    ("", "Permission is hereby refused to any person without a ticket."),
]


def test_unseen_wordings(spark, model):
    """Accuracy on wordings that neither the weights nor the temperature have seen, and calibration."""
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(UNSEEN)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    right = sum(got[i].families == f for i, (f, _) in enumerate(UNSEEN))
    assert right >= len(UNSEEN) - 2 and all(got[i].families == "" for i, (f, _) in enumerate(UNSEEN) if not f)
    named = [got[i] for i, (f, _) in enumerate(UNSEEN) if got[i].families]
    mean = sum(r.probability for r in named) / len(named)
    assert abs(mean - 1) < 0.25  # all that is named is right here, so the mean probability should be near one


def test_least_words():
    assert licenses._least_words(["a b", "b c", "c d"], 2) == 2 and licenses._least_words(["a b"], 1) == 2 and licenses._least_words([], 0) == 0


# ---------------------------------------------------------------- archives


def _pages(spark):
    long, other = "<p>" + "a" * 200 + "</p>", "é漢😀" * 60
    rows = [(5, "http://a/", long), (3, "http://b/ x", long), (9, None, long), (4, "http://c/", "tiny"), (2, "http://d/", "tiny"), (7, "", ""), (8, "u", None), (6, "u", other), (1, "v", other), (1, "v", other), (None, "w", long), (10, "r", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20), (11, "z", "x" * 3_000_000)]
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "page_id long, url string, html string, digest string, size string, n string")


def test_archives_come_back(spark):
    pages = _pages(spark)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, data in rows:
        if i is not None and len(data) >= 100:
            first[data] = min(first.get(data, i), i)
    want = []
    for i, data in rows:
        again = i is not None and len(data) >= 100 and first[data] != i
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    out = warc.roundtrip(pages)
    got = out.collect()
    assert sorted(map(str, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert warc.roundtrip(pages.limit(0)).count() == 0
    # more revisits than are sent to every task are joined
    for limit in (0, 100):
        plan = warc.plan_records(pages, broadcast_rows=limit).collect()
        assert sorted(map(str, ((str(r.page_id), r.size, r.digest, "revisit" if r.refers_to is not None else "response", r.refers_to) for r in plan))) == sorted(map(str, want))


def test_normaliser(tmp_path):
    records = [warc.record("response", k, f"http://x/{k}", b"p" * k * 1000, "d", k * 1000) for k in range(30)]
    source, target = f"{tmp_path}/in/a.warc.gz", f"{tmp_path}/out.warc.gz"
    assert warc.write_monolithic(source, iter(records)) == 30
    assert warc.normalise(source, target) == 30
    index = list(warc.read_index(target))
    assert [x["page"] for x in index] == list(range(30)) and all(x["kind"] == "response" for x in index)
    raw = open(target, "rb").read()
    assert gzip.decompress(raw) == b"".join(records)
    assert [gzip.decompress(raw[x["offset"] : x["offset"] + x["length"]]) for x in index] == records
    (fields, block), *_ = warc.read_at(target, iter([(index[7]["offset"], index[7]["length"])]))
    assert fields["warc-page-id"] == "7" and block.endswith(b"p" * 7000)
    # an archive that is in members already is inflated the same way
    assert b"".join(warc.inflate(io.BytesIO(raw))) == b"".join(records)
    # an archive cut anywhere is an error, also where a record ends
    whole = open(source, "rb").read()
    for broken in (whole[:-1], whole[: len(whole) // 2], raw[: index[9]["offset"] - 1]):
        with pytest.raises(ValueError, match="inside"):
            list(warc.inflate(io.BytesIO(broken)))
    assert b"".join(warc.inflate(io.BytesIO(raw[: index[9]["offset"]]))) == b"".join(records[:9])
    zeros = gzip.compress(bytes(5_000_000))
    assert sum(map(len, warc.inflate(io.BytesIO(zeros)))) == 5_000_000
    with pytest.raises(ValueError):
        list(warc.split_records(iter([records[0][:-3]])))
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"not a record\r\n\r\n"])))


# ---------------------------------------------------------------- chat


def test_turns_come_back():
    rng = random.Random(7)
    pieces = [*chat.CONTROL, "\\", " ", "\n", "<", "[", "]", ">", "x", "é", "</", "<<s>>", "[[INST]]", " </s>"]
    turns = [(rng.choice(["user", "assistant", "system", "tool", "odd\n<|text|>", ""]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for _ in range(500)]
    made = [chat.format_turn(*t) for t in turns]
    assert all(c not in chat.escape(t) for _, t in turns for c in chat.CONTROL)
    for size in (1, 7, 10_000):
        reader, got, whole = chat.TurnReader(), [], "".join(m[0] for m in made)
        for i in range(0, len(whole), size):
            got += [(r, t) for r, t, _ in reader.feed(whole[i : i + size])]
        assert got == turns and not reader.held
    assert all(chat.unescape(m[a:b]) == t for (m, a, b), (_, t) in zip(made, turns, strict=True))
    with pytest.raises(ValueError):
        list(chat.TurnReader().feed("this is not a formatted conversation"))


def test_reply_paths(spark):
    """Against walking up from every leaf: trees, a long chain, an orphan and a ring."""
    rng = random.Random(11)
    rows = [(1, k, rng.randrange(k) if k else None, rng.random()) for k in range(60)] + [(2, k, k - 1 if k else None, None) for k in range(70)] + [(3, 5, 99, 1.0), (4, 1, 2, 1.0), (4, 2, 1, 1.0), (4, 7, None, 0.0), (5, 0, None, 1.0), (5, 1, 0, 2.0), (5, 2, 0, 2.0)]
    nodes = spark.createDataFrame([*rows, rows[3]], "tree long, node long, parent long, score double")
    known = {(t, n): (p, s or 0.0) for t, n, p, s in rows}
    parents = {(t, p) for t, _, p, _ in rows}
    branches = {}
    for t, n in known:
        if (t, n) in parents or t == 4 and n != 7:
            continue
        path, at = [], n
        while at is not None and (t, at) in known:
            path.append(at)
            at = known[t, at][0]
        branches.setdefault(t, []).append((-round(sum(known[t, x][1] for x in path), 9), -len(path), n, path[::-1]))
    for top in (1, 3):
        want = {(t, k, i, n) for t, own in branches.items() for k, (_, _, _, path) in enumerate(sorted(own)[:top]) for i, n in enumerate(path)}
        assert {tuple(r) for r in chat.reply_paths(nodes, top).collect()} == want
    assert chat.reply_paths(nodes.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "a\\b [INST]"), (1, 2, None, None), (2, 5, "system", ""), (2, 3, "assistant", None), (2, 4, "assistant", "é😀"), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "assistant", "y"), (None, 0, "tool", "t"), (None, None, "user", "u")]
    table = spark.createDataFrame([(*r, "c", "c") for r in rows], "conv_id long, turn long, role string, text string, tree string, path string")
    got = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        own = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: [(x is not None, x if x is not None else 0) for x in r[:1]] + [(x is not None, x or "") for x in r[1:]])
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own)
        loss = "".join(t or "" for _, r, t in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.format_turn(role, text)[0]) for _, role, text in own)
    assert chat.format_conversations(table.limit(0)).count() == 0
