"""Corpus operators on edge cases and small tables, against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lakeloom.llm import chat_format, decontamination, html_extraction, packing, sharding, shingle_dedup, simhash, suffix_dedup, token_counts, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, mark string, _row string, bucket string, length string"
ODD = [None, "", " ", "a", "a b", "x" * 300, "\n\t ", "naïve café 日本 \U0001f600", "<|endoftext|> and <|startoftext|>", "A B C d e f", "a b c D E F"]


def documents(spark, n=60, seed=1):
    """Texts with copies, near copies, shared passages, nulls, repeated ids, and columns that clash with inner names."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(n)]
    texts += [texts[0]] * 5 + [f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}" for t in texts[:8]] + ODD
    texts += [texts[1] + " end", texts[2].upper()]
    ids = [*range(len(texts) - 2), 3, None]
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", "b", "l") for i, t in zip(ids, texts, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_token_counts_equal_the_library(docs, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    got = sorted(map(tuple, token_counts.count_tokens(docs, limit=40).collect()), key=str)
    c = token_counts.counter()
    want = [(d, len(t.encode()), n, n > 40, c.cut(t, 40) if n > 40 else len(t)) for d, t in rows for n in [len(tokenizer.encode(t, add_special_tokens=False).ids)]]
    assert got == sorted(want, key=str)


def test_prefix_counts_equal_encoding_every_prefix():
    tokenizer, c, rng = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY)), token_counts.counter(), random.Random(2)
    parts = ["a", " ", "  ", "\n", "'", "'re", "é", "<|endoftext|>", "日本", "1", "%%", "the", " of", "\U0001f600", "　"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        p = c.prefixes(text)
        want = [len(tokenizer.encode(text[:j], add_special_tokens=False).ids) for j in range(len(text) + 1)]
        assert all(x in (-1, y) for x, y in zip(p, want, strict=True)) and p[-1] == want[-1]
        assert c.cut(text, 3) == max(j for j in range(len(text) + 1) if 0 <= p[j] <= 3)


def test_packing(spark, docs, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack_documents(docs, 64).collect()
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want += [(d, k, a, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64)) for p in [ids[a : a + 64]]]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert sum(n for _, n in p) <= 64
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))]
    assert len(places) <= -(-sum(r.length for r in got) // 64) + 1


def test_sharding(docs, rows):
    got = sharding.shard_by_bytes(docs, 4, tolerance=0.05).collect()
    want = sorted(((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(4):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 4) <= 2 * (0.05 * total / 4 + largest)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def reachable(prints):
    """Smallest reachable position of each print, by brute force."""
    label = list(range(len(prints)))
    for _ in prints:
        new = [min(label[j] for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(prints))]
        if new == label:
            break
        label = new
    return label


def test_simhash(docs, rows):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [fingerprint(t) for _, t in rows]
    label = reachable(prints)
    least = {}
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    assert got == {(d, f"{p:016x}", least.get(x)) for (d, _), p, x in zip(rows, prints, label, strict=True)}


def test_gray_index_finds_all_links_and_splits_large_buckets(spark):
    rng = random.Random(4)
    codes = {rng.getrandbits(64) for _ in range(300)}
    for base in list(codes)[:6]:
        for _ in range(50):
            base ^= 1 << rng.randrange(64)
            codes.add(base)
    codes = sorted(codes)
    nodes = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "_fp long")
    label = reachable(codes)
    for split_over in (1000, 16):
        root = {r._fp & ((1 << 64) - 1): r._root for r in simhash.components(simhash.links(nodes, split_over=split_over)).collect()}
        groups = {}
        for c, x in zip(codes, label, strict=True):
            groups.setdefault(x, set()).add(root.get(c, c if not c >> 63 else c - (1 << 64)))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_representatives_keep_one_row_of_each_group(docs, rows):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    label = reachable([fingerprint(t) for _, t in rows])
    assert kept.count() == len(set(label))


def removed(rows):
    out, seen = [], {}
    for d, t in rows:
        raw = t.encode()
        for w in {raw[i : i + 50] for i in range(len(raw) - 49)}:
            seen[w] = min(seen.get(w, 1 << 63), (1 << 63) - 1 if d is None else d)
    for d, t in rows:
        raw, own = t.encode(), (1 << 63) - 1 if d is None else d
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < own:
                gone[i : i + 50] = b"\1" * 50
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, rows):
    assert sorted(map(tuple, suffix_dedup.removals(docs).collect()), key=str) == removed(rows)


def test_suffix_dedup_of_periodic_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 512)
    rng = random.Random(6)
    long = "".join(rng.choice("ab") for _ in range(3000))
    texts = ["ab" * 200, "ab" * 90, "a" * 120, long, long[700:1900], "z" + long[5:400] + "q" + long[300:380], "é" * 60, "xé" + "é" * 58]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.removals(table).collect()), key=str)
    assert got == removed(list(enumerate(texts)))


def test_suffix_dedup_with_hot_anchors_many_levels_and_the_largest_id(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4096)
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    monkeypatch.setattr(suffix_dedup, "BATCH", 8)
    rng = random.Random(16)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = word(40), word(90)  # a line shorter than a window, in many contexts, and a longer passage
    texts = [word(rng.randint(0, 80)) + line + word(rng.randint(0, 80)) + rng.choice(["", passage, passage[20:]]) for _ in range(150)]
    texts = [rng.choice(texts[:20]) if rng.random() < 0.2 else t for t in texts]
    ids = [*range(148), suffix_dedup.LAST, suffix_dedup.LAST - 1]
    rng.shuffle(ids)
    table = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.removals(table).collect()), key=str)
    assert got == removed(list(zip(ids, texts, strict=True)))


def test_decontamination(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (13, 20, 40, 12, 5)]
    change = lambda ws, at: [word() if i in at else w for i, w in enumerate(ws)]
    body = lambda ws: " ".join([*(word() for _ in range(30)), *ws, *(word() for _ in range(30))])
    texts = [body(items[0]), body(change(items[1], {3, 9, 15})), body(items[2][10:30]).upper(), body(items[2][:9]), body([]), None, "", body(items[3]), body(change(items[0], {2, 5, 8}))]
    texts += [" ".join(items[4]), body(items[4][:4]), body(change(items[3], {5}))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _h string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench).collect()}
    assert got == {(r.doc_id, r.item_id) for r in decontamination.overlaps(docs, bench, most_hashes=20).collect()}
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for d, t in enumerate(texts):
        for i, b in enumerate(items):
            w = words(t)
            if any(sum(x == y for x, y in zip(w[p : p + 13], b[q : q + 13], strict=True)) >= 11 for p in range(len(w) - 12) for q in range(len(b) - 12)):
                want.add((d, i))
            if len(b) < 13 and any(w[p : p + len(b)] == b for p in range(len(w))):
                want.add((d, i))
    assert got == want == {(0, 0), (1, 1), (2, 2), (7, 3), (9, 4)}
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 8, 10, 11}


def test_masks_tolerate_two_substitutions():
    from itertools import combinations

    places = [frozenset(p + m for m in mask) for mask in decontamination.MASKS for p in range(decontamination.WINDOW - max(mask))]
    assert all(any(not q & set(c) for q in places) for c in combinations(range(decontamination.WINDOW), 2))


def test_top_k(spark):
    rng = np.random.default_rng(8)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(300)]
    vectors += [(400, None), (450, [float("nan")] * 16), (500, [None] * 16), (550, vectors[3][1]), (600, vectors[3][1]), (None, vectors[0][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, v int")
    q = topk.quantised(table)
    got = sorted(map(tuple, topk.top_k(q, q.where("vec_id % 50 = 0")).collect()))
    con = duckdb.connect()
    frame = table.drop("v").toPandas()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(None if i != i else int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(frame["vec_id"], frame["embedding"], strict=True)])
    assert got == sorted(con.sql(topk.OP7_SQL).fetchall())


def test_html(spark):
    nav = "<nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
    page = lambda i: f"<html><head><title>t</title><script>if (a < b) '</p>'</script></head><body>{nav}<div class='ad-box ad'>Buy</div><article><h1>T{i} &amp; co</h1><p><b>one\n {i}<br><p>two<i>!</i></p><section class='comments'><p>nice</p></section></article><footer>&copy;</footer>"
    plain = lambda i: f"<div>Shared line</div><p>own {i}</p>"
    pages = [(i, f"http://a.example/{i}", page(i)) for i in range(3)] + [(10 + i, f"http://b.example/{i}", plain(i)) for i in range(3)]
    pages += [(20, None, None), (21, "http://c.example", ""), (22, "http://c.example", "a < b"), (0, "http://a.example/0", page(0))]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = html_extraction.extract(table).collect()
    want = {**{i: f"T{i} & co\n\none {i}\n\ntwo!" for i in range(3)}, **{10 + i: f"own {i}" for i in range(3)}, 20: "", 21: "", 22: "a < b"}
    assert len(got) == len(pages) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_html_classes_and_slots_equal_brute_force(spark):
    rng = random.Random(17)
    menus = {s: "".join(f"<li>{s} {k}</li>" for k in range(4)) for s in "xyz"}
    pages = []
    for i in range(150):
        host, section = rng.choice("abc"), rng.choice("xyz")
        odd = f"<h2>{rng.choice('pqr')}</h2>" if rng.random() < 0.3 else ""
        body = f"<div><b>top</b><ul>{menus[section]}</ul><i>mid</i></div>{odd}<p>own {i}</p><section><p>also {rng.randint(0, 4)}</p></section><address>end</address>"
        pages.append((i, f"http://{host}.example/{i}", "<h1>lost</h1>" if i == 7 else f"<body>{body}</body>"))
    pages += [(900 + k, *p[1:]) for k, p in enumerate(pages[:5])]  # copies count once
    on, at = {}, {}
    for _, url, source in pages:
        for token, place in html_extraction.Page(source).tokens().items():
            on.setdefault((url[7], token), set()).add(source)
            at[url[7], token, source] = place
    want = {}
    for (host, token), where in on.items():
        want.setdefault((host, frozenset(where)), []).append(token)
    want = {k: v for k, v in want.items() if len(k[1]) >= 3 and len(v) >= 3}
    order = lambda host, tokens, source: sorted(tokens, key=lambda t: at[host, t, source])
    want = sorted((len(w), order(host, tokens, min(w))) for (host, w), tokens in want.items())
    table = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, host int, template string")
    found = html_extraction.valid_classes(html_extraction.occurrences(html_extraction.sources(table))).collect()
    assert sorted((r.pages, [t % (1 << 64) for t in r.tokens]) for r in found) == want and len(want) > 6
    few = {r.page_id: r.text for r in html_extraction.extract(table).collect()}
    many = {r.page_id: r.text for r in html_extraction.extract(table, broadcast_tokens=0).collect()}
    assert few == many and few[7] == "lost"
    for i, _, source in pages:
        if i != 7:  # menus of a section, the top and the end are template; what varies is text
            own = re.findall(r"<h2>(.)</h2>|<p>([^<]*)</p>", source)
            assert few[i] == "\n\n".join(a or b for a, b in own)


def test_html_drops_by_whole_names_only():
    slots = lambda source: html_extraction.Page(source).slots({})
    kept = ["ad-hoc note", "share-price", "menu-history", "headline", "commentary"]
    assert slots("<article>" + "".join(f"<p class='{k}' id='{k}'>{k}</p>" for k in kept) + "</article>") == kept
    gone = ["ad", "ad-slot-2", "site-footer", "comment-list", "x sidebar", "share_buttons"]
    assert slots("<article>" + "".join(f"<div class='{k}'><p>{k}</p></div>" for k in gone) + "a</article>") == ["a"]
    assert slots("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><noscript><p>n</p></noscript>") == ["Let x=1 be", "n"]
    assert slots("<main><p>intro</p><article><p>a</p></article><aside>b</aside></main><p>c</p>") == ["intro", "a"]


def test_chat_blocks_give_the_path_of_the_whole_conversation(spark, monkeypatch):
    turns = [(c, t, ("user", "assistant")[t % 2], f"line {t}\nand {c * t}" + "?" * (t % 2 == 0)) for c in range(6) for t in range(9)]
    turns += [(None, 0, "user", "hi"), (7, None, "system", None), (8, 0, "other", ""), (0, 0, "user", "line 0\nand 0?")]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, line string")
    raw = chat_format.transcripts(table)
    model = chat_format.fit(raw)
    whole = sorted(map(tuple, chat_format.parse(raw, model).collect()), key=str)
    monkeypatch.setattr(chat_format, "BLOCK_TURNS", 2)
    assert sorted(map(tuple, chat_format.parse(raw, model).collect()), key=str) == whole and whole


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(9)
    model = chat_format.Model(rng.integers(0, 9, 6), rng.integers(0, 9, (6, 6)), rng.integers(0, 9, (6, chat_format.CODES)))
    codes = rng.integers(0, chat_format.CODES, 5)
    weight = lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:])) + sum(model.emit[c, s] for c, s in zip(codes, p, strict=True))  # noqa: B905, E731
    assert np.isclose(weight(model.trace(codes, None, None)), max(map(weight, product(range(6), repeat=5))))


def test_chat_recovers_roles_of_conversations_that_did_not_train(spark):
    turns = chat_format.transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    graded = turns.where(chat_format.held_out())
    parsed = chat_format.parse(graded, chat_format.fit(turns.where(~chat_format.held_out()))).orderBy("conv_id", "turn").collect()
    truth = graded.orderBy("conv_id", "turn").collect()
    lines = lambda rows, n: [(r.conv_id, r.role) for r in rows for _ in range(n(r))]
    got, want = lines(parsed, lambda r: r.n_lines), lines(truth, lambda r: r.text.count("\n") + 1)
    assert len(got) == len(want) > 100 and [c for c, _ in got] == [c for c, _ in want]
    assert sum(a == b for a, b in zip(got, want, strict=True)) / len(want) > 0.9


def test_toxicity_separates_held_out_documents(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    bad = ["venomous", "rottenly", "vilebody", "crudejerk"]
    rows = []
    for i in range(600):
        ws = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws), int(toxic)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "a", "x"), (900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in held} | {i for i in (900, 901) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i].predicted == y for i, y in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values()) and got[900].predicted == 0
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got.values())
    assert toxicity.score(docs.select("doc_id", "text"), None).where("score > 0").isEmpty()


def test_large_ids_stay_exact_beside_nulls(spark):
    big = (1 << 62) + 1
    docs = spark.createDataFrame([(big, "a text " * 20), (None, None), (3, "b")], "doc_id long, text string").coalesce(1)
    ids = lambda rows, c="doc_id": sorted({str(r[c]) for r in rows.collect()})
    want = sorted(["3", "None", str(big)])
    for found in (token_counts.count_tokens(docs), toxicity.score(docs, None), simhash.near_duplicates(docs), packing.pack_documents(docs), suffix_dedup.removals(docs), sharding.sharded(docs) if hasattr(sharding, "sharded") else docs, shingle_dedup.representatives(docs)):
        assert ids(found) == want
    pages = docs.select("doc_id", "text").toDF("page_id", "html").withColumn("url", F.lit("http://a.example"))
    assert ids(html_extraction.extract(pages), "page_id") == want
    turns = chat_format.transcripts(spark.createDataFrame([(big, 0, "user", "hi"), (None, 0, "user", "ho"), (3, 0, "assistant", "x")], "conv_id long, turn long, role string, text string").coalesce(1))
    assert ids(chat_format.parse(turns, chat_format.fit(turns)), "conv_id") == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(docs).isEmpty() and packing.pack_documents(docs).isEmpty() and sharding.shard_by_bytes(docs).isEmpty()
    assert simhash.near_duplicates(docs).isEmpty() and suffix_dedup.removals(docs).isEmpty() and suffix_dedup.remove_repeats(docs).isEmpty()
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.overlaps(docs, bench).isEmpty() and decontamination.decontaminate(docs, bench).isEmpty()
    vectors = topk.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(vectors, vectors).isEmpty()
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()
    turns = chat_format.transcripts(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat_format.parse(turns, chat_format.fit(turns)).isEmpty()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.reject_toxic(docs, labels).isEmpty()


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    documents(spark, 30, 11).write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(f"w{i}x" for i in range(20))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    leak = spark.createDataFrame([(1000, f"before {item} after", "en", "s", 1, "x", "y", "z", "b", "l")], SCHEMA)
    docs = docs.unionByName(leak)
    for (_, stage), n in zip(corpus_pipeline.STAGES[:-1], range(4), strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        before, after = docs.collect(), out.collect()
        if n == 0:
            assert len(after) == len(before)
        elif n == 1:
            assert len(after) == len(set(shingle_groups([r.text or "" for r in before])))
        elif n == 2:
            want = removed([(r.doc_id, r.text or "") for r in before])
            assert len(after) == sum(not x[2] or x[1] > x[2] for x in want)
            assert sum(len((r.text or "").encode()) for r in after) <= sum(x[1] - x[2] for x in want)
        else:
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {1000}
        docs = spark.createDataFrame(after, SCHEMA)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len({(r.doc_id, r.piece, r.ids_crc32) for r in packed}) <= len(packed) and sum(r.piece == 0 for r in packed) == docs.count()


def shingle_groups(texts):
    """The component of each text by brute force: pairs with Jaccard similarity of 0.8 or more of five-word shingles."""
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)})
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def near_copies(seed=12):
    """Texts, and copies of them with some edited words, whose similarity is 0.8 to 0.95 or just below 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(60):
        base = [word() for _ in range(404)]
        # each edit apart from others replaces 5 of 400 shingles: n edits leave (400 - 5n) / (400 + 5n)
        texts += [" ".join(base)] + [" ".join(word() if at in {40 * k + 20 for k in range(n)} else w for at, w in enumerate(base)) for n in (1 + i % 8, 9)]
    return texts


def test_pipeline_finds_near_copies_from_four_fifths(spark, tmp_path):
    texts = near_copies()
    texts += [texts[0], texts[0].upper(), None, " ", "a b c", "A  b c"]
    texts += [" ".join(texts[9].split()[:k]) for k in range(404, 300, -8)]  # a chain whose ends are below 0.8
    label = shingle_groups([t or "" for t in texts])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "no id", "x")], "doc_id long, text string, _id string")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    want = [min(i for i, x in enumerate(label) if x == own) for own in sorted(set(label))]
    assert sorted(kept, key=str) == sorted([*want, None], key=str)
    assert 60 < len(want) < len(texts) - 60


def test_toxicity_does_not_rise_with_length():
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(400)]
    bad = ["".join(rng.choice("qrstuvwx") for _ in range(8)) for _ in range(40)]

    def text(n, share):
        return " ".join(rng.choice(bad) if rng.random() < share else rng.choice(words) for _ in range(n))

    lengths = [rng.randint(30, 120) for _ in range(400)]
    toxic, ordinary = [text(n, 0.06) for n in lengths], [text(n, 0.0005) for n in lengths * 2]
    of = toxicity.scorer(toxicity.fit(toxic, ordinary))
    clean = of([text(20_000, 0.0005) for _ in range(20)])  # about 10 such words each
    assert (clean >= 0.7).mean() <= 0.05
    assert (of([text(4_000, 0.06) for _ in range(20)]) >= 0.7).all()
    passage = [f"{text(4_000, 0)} {text(200, 0.5)} {text(4_000, 0)}" for _ in range(20)]  # a passage does not drown
    assert (of(passage) >= 0.7).all()


def test_toxicity_sample_holds_long_documents(spark):
    docs = spark.createDataFrame([(i, "word " * (8_000 if i % 2 else 5)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in range(40)], "doc_id long, toxic int")
    assert sorted(len(t) for _, t in toxicity.labelled(docs, labels))[-1] == 40_000


@pytest.fixture
def layout(spark):
    """Changes how files are split into scan partitions, as a lost executor does."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def split(*values):
        for n, v in zip(names, values, strict=True):
            spark.conf.set(n, v)

    yield split
    for n, v in before.items():
        if v is None:
            spark.conf.unset(n)
        else:
            spark.conf.set(n, v)


def test_packing_is_the_same_when_scans_are_split_anew(spark, layout):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(400)], "doc_id long, text string").repartition(16)
    layout("128m", "0", "1")
    packed = packing.pack_documents(docs, 64)
    layout("64k", "64k", "16")
    got = packed.collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert len({(r.sequence_id, r.offset) for r in got}) == 400


def test_representatives_are_the_same_when_scans_are_split_anew(spark, layout, tmp_path):
    rng = random.Random(14)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(999)) for _ in range(20)) for _ in range(60)]
    table = spark.createDataFrame([(i, texts[i % 60]) for i in range(240)] + [(0, texts[0])], "doc_id long, text string")
    table.repartition(12).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for stage in (simhash.representatives, lambda d: corpus_pipeline.near_dedup(spark, d, "")):
        layout("128m", "0", "1")
        kept = stage(docs)
        layout("64k", "64k", "16")
        assert sorted(r.doc_id for r in kept.collect()) == list(range(60))


def kept_bytes(rows):
    """What suffix dedup leaves of (id, text) rows, by brute force."""
    seen = {}
    for d, t in rows:
        raw = t.encode()
        for i in range(len(raw) - 49):
            seen[raw[i : i + 50]] = min(seen.get(raw[i : i + 50], d), d)
    out = {}
    for d, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        if left or not any(gone):
            out[d] = left.decode(errors="ignore")
    return out


def best_fit(lengths, capacity):
    """How many sequences best-fit decreasing needs."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    return len(gaps)


def test_pipeline_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(18)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(600)]
    bad = ["".join(rng.choice("qrstuvwx") for _ in range(8)) for _ in range(30)]
    say = lambda n, toxic=False: " ".join(rng.choice(bad) if toxic and rng.random() < 0.2 else rng.choice(words) for _ in range(n))
    passage, item = say(70), " ".join(f"w{i}x" for i in range(20))
    texts = [(say(rng.randint(20, 120), i % 5 == 0), int(i % 5 == 0)) for i in range(300)]
    texts += [(texts[1][0], 0), (texts[2][0] + " end", 0), (f"{say(30)} {passage} {say(30)}", 0), (f"{say(40)} {passage} {say(9)}", 0), (f"{say(20)} {item} {say(9)}", 0), (None, 0), ("", 0)]
    long = say(5000)  # longer than a sequence
    texts.append((long, 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, (t, _) in enumerate(texts)], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(texts)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    train = [(i, t or "", x) for i, (t, x) in enumerate(texts) if zlib.crc32(str(i).encode()) % 3 != 1]
    train.sort(key=lambda r: (r[0] * 2654435761) % (1 << 32))
    scores = toxicity.scorer(toxicity.fit([t for _, t, x in train if x], [t for _, t, x in train if not x]))([t or "" for t, _ in texts])
    assert all((s >= 0.7) == bool(x) for s, (_, x) in zip(scores, texts, strict=True))
    rows = [(i, t or "") for (i, (t, _)), s in zip(enumerate(texts), scores, strict=True) if s < 0.7]
    group = shingle_groups([t for _, t in rows])
    rows = [r for r, g in zip(rows, group, strict=True) if r[0] == min(x[0] for x, h in zip(rows, group, strict=True) if h == g)]
    rows = [(d, t) for d, t in kept_bytes(rows).items() if not any(w in t for w in [" ".join(f"w{i}x" for i in range(k, k + 13)) for k in range(8)])]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want += [(d, k, a, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096)) for p in [ids[a : a + 4096]]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 4096
    assert len(places) == best_fit([n for *_, n, _ in want], 4096)
    assert any(r.piece == 1 for r in got) and len(rows) < 250


def test_pipeline_joins_what_fingerprints_propose(spark, tmp_path, monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(1200)) for i in range(20)]
    texts += [t + " end" for t in texts] + [" ".join([f"v{i}"] * 900 + [f"u{i}x{k}" for k in range(3 + 40 * j)]) for i in range(5) for j in range(2)]
    label = reachable([fingerprint(t) for t in texts])
    alike = shingle_groups(texts)
    want = [i for i, x in enumerate(alike) if not any(alike[j] == x and label[j] == label[i] for j in range(i))]
    assert len(want) < 40 and len(set(label)) < len(want)  # some that fingerprints link are not similar enough
    monkeypatch.setattr(shingle_dedup, "bands", lambda found: [shingle_dedup.node(found) + b for b in range(shingle_dedup.BANDS)])  # no band proposes any
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == want
