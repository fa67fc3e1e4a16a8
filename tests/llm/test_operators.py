import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from odd_rows import ODD

from namefold.llm import chat, decontaminate, exact_dedup, jaccard_join, line_dedup, packing, quality, toxicity, url_filter, warc
from namefold.llm.queries import word_tokenizer


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Exact dedup.


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("snapshots, broadcast", [(1, 500_000), (3, 0)])
def test_exact_dedup(spark, docs_of, monkeypatch, snapshots, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", broadcast)
    rows = ODD + [(100 + k, f"Copy {k % 7}") for k in range(60)]
    assert rows_of(exact_dedup.deduplicate(docs_of(rows), snapshots)) == exact_by_hand(rows)


def test_exact_dedup_compares_bytes_when_digests_collide(spark, docs_of):
    rows = [(k, f"text {k % 5}") for k in range(40)] + [(50, "alone")]
    weak = lambda x: bytes([len(x) % 2]) * 8
    assert rows_of(exact_dedup.deduplicate(docs_of(rows), digest=weak)) == exact_by_hand(rows)


def test_only_suspect_texts_leave_the_scan(spark, docs_of):
    rows = [(k, f"alone {k}") for k in range(30)] + [(40, "Twice"), (41, "tWICE")]
    suspects = spark.createDataFrame([(bytearray(hashlib.sha256(b"twice").digest()), 2)], "digest binary, n long")
    sent = exact_dedup.suspect_texts(docs_of(rows), suspects, len(rows)).collect()
    assert sorted((r["doc_id"], bytes(r["text"])) for r in sent) == [(40, b"twice"), (41, b"twice")]


def test_fuse_filter():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 5000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        made = exact_dedup.FuseFilter.build(np.concatenate([keys, keys[:3]]))
        assert made.contains(keys).all()
        assert made.contains(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.001


# Line dedup.


def lines_by_hand(rows, min_docs=5, min_chars=40):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    drop = {k: max((x for x in ids if x is not None)) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or drop[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark, docs_of):
    long = "This LINE is long enough to be looked at, surely"
    short = "x" * 39
    wide = "ß" * 40
    rows = ODD + [(20 + k, f"{'  ' * k}{long}\nown {k}\n{short}\n{long.upper()}\n{wide}\n\t") for k in range(6)] + [(40 + k, "y" * 45) for k in range(4)] + [(43, "y" * 45)]
    assert rows_of(line_dedup.digests(docs_of(rows))) == lines_by_hand(rows)


def test_line_dedup_keeps_columns(spark, docs_of):
    df = docs_of([(k, "common " * 10 + f"\nown {k}") for k in range(6)])
    out = line_dedup.clean(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert {(r["kept_text"], r["n_lines"], r["_drop"], r["row"]) for r in out.collect()} == {("own kept_text", "own n_lines", "own _drop", "own row")}
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(k, f"own {k}", 5) for k in range(5)} | {(5, "common " * 10 + "\nown 5", 76)}


# Jaccard join.


def groups_by_hand(rows, width=5):
    """The component of each row, None for a row without shingles."""
    sets = shingles_by_hand(rows, width)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
    return [find(i) if sets[i] else None for i in range(len(rows))]


def shingles_by_hand(rows, width=5):
    words = ([x for x in re.split("[\x20\x09-\x0d]+", low(t)) if x] for _, t in rows)
    return [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for w in words]


def components_by_hand(rows, width=5):
    sets, root = shingles_by_hand(rows, width), groups_by_hand(rows, width)
    groups = defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        groups[r].append(i)
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((i, len(s), i if r is None else least[r]) for (i, _), s, r in zip(rows, sets, root, strict=True)), key=str)


def similar_rows(n=70, words=80, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(k % 6):
            w[rng.integers(0, words)] = f"x{rng.integers(0, 10**6)}"
        rows.append((200 + k, " ".join(w)))
    return rows + [(500 + k, " ".join(base[:30] + [f"z{k}y{j}" for j in range(30)])) for k in range(20)]


@pytest.mark.parametrize("list_pairs, block_tokens, links, hot", [(4096, 400_000, 300_000, 150_000), (10, 2000, 0, 20)])
def test_jaccard_join(spark, docs_of, monkeypatch, list_pairs, block_tokens, links, hot):
    monkeypatch.setattr(jaccard_join, "HOT_LIST", hot)
    monkeypatch.setattr(jaccard_join, "SMALL_LINKS", links)
    monkeypatch.setattr(jaccard_join, "LIST_PAIRS", list_pairs)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", block_tokens)
    rows = ODD + similar_rows() + [(600, "a b c"), (601, "A  B\tc"), (602, "a b"), (603, "a b c d e"), (604, "a b c d e")]
    assert rows_of(jaccard_join.join(docs_of(rows))) == components_by_hand(rows)


def test_jaccard_join_through_rows_without_id(spark, docs_of):
    """Two sets that link only through a third, whose rows have no id; one text that stands under one id beside others."""
    words = [f"w{k}" for k in range(60)]
    left, middle, right = words[:46], words[4:50], words[8:54]
    rows = [(5, " ".join(left)), (2, " ".join(right)), (None, " ".join(middle)), (None, " ".join(middle)), (7, "u v w x y z"), (None, "u v w x y z"), (None, "only without an id of its own"), (None, "only without an id of its own"), (None, None), (7, "another text of id seven")]
    assert rows_of(jaccard_join.join(docs_of(rows))) == components_by_hand(rows)
    got = dict(zip([r for r, _ in rows[:3]], [2, 2, 2], strict=True))
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.join(docs_of(rows[:3])).collect()} == set(got.items())


def test_derived_answers_equal_verified_ones(spark, docs_of):
    """Overlaps told by a pivot's answers and differences are those of the whole sets."""
    docs = docs_of(similar_rows(n=14) + [(None, similar_rows(n=14)[3][1] + " tail")]).select("doc_id", "text")
    nodes = jaccard_join._nodes(jaccard_join.sets(docs, 5)).cache()
    p = next(r["node"] for r in nodes.collect() if r["rep"] == 200)
    others = [r["node"] for r in nodes.collect() if r["node"] != p]
    kind = "p long, x long"
    checked = jaccard_join.verify(docs, spark.createDataFrame([(p, x) for x in others], kind), nodes, 5, differences=True)
    rows = checked.collect()
    asked = [(y["x"], x["x"], p, y["inter"]) for x in rows if x["gone"] is not None for y in rows if y["x"] != x["x"]]
    assert len(asked) > 20
    told = jaccard_join.derive(docs, spark.createDataFrame(asked, "y long, x long, via long, shared long"), checked, nodes, 5)
    whole = jaccard_join.verify(docs, spark.createDataFrame([(y, x) for y, x, _, _ in asked], kind), nodes, 5)
    assert rows_of(told) == rows_of(whole) and told.count() == len(asked)


def one_of_each_by_hand(rows):
    """What stays, as sorted rows: of each component the least id, nulls last."""
    left = defaultdict(list)
    alone = []
    for (i, t), root in zip(rows, groups_by_hand(rows), strict=True):
        if root is None:
            alone.append((i, t))
        else:
            left[root].append((i is None, i or 0, i))
    return sorted(map(str, [i for i, _ in alone] + [min(x)[2] for x in left.values()]))


def test_one_of_each(spark, docs_of):
    df = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "z z z z z y"), (3, "z z z z z y"), (None, "q")])
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "None"]


def test_one_of_each_goes_by_rows(spark, docs_of):
    """An id on several texts loses only those that are copies."""
    t, u, v = "a b c d e f g h", "some text that is like no other", "a third text unlike the first two"
    assert sorted((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs_of([(1, t), (3, t), (3, u), (4, u), (4, v), (4, v)])).collect()) == [(1, t), (3, u), (4, v)]
    assert sorted((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs_of([(3, u), (3, v)])).collect()) == [(3, v), (3, u)]
    rows = ODD + similar_rows() + [(None, r[1]) for r in similar_rows()[:5]]
    out = jaccard_join.one_of_each(docs_of(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == one_of_each_by_hand(rows)


# Benchmark decontamination.


def hits_by_hand(rows, items, size=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - size + 1, min(len(w), 1))):
            windows[tuple(w[k : k + size])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids:
                    found |= ids
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [4 << 20, 150])
def test_decontamination(spark, docs_of, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    passage = " ".join(f"b{k}" for k in range(30))
    items = [(1, passage), (2, "Short item-here"), (3, None), (4, "..."), (5, "one"), (None, "no id item"), (7, passage), (10, "rep rep " * 10), (1, passage)]
    rows = ODD + [(30, f"Lead {passage.upper()} tail"), (31, " ".join(passage.split()[5:18])), (32, " ".join(passage.split()[5:17])), (33, "short, item here; one"), (34, "rep " * 40 + "no id item"), (34, "rep " * 40 + "no id item"), (35, "w " * 400 + passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontaminate.digests(docs_of(rows), bench)) == hits_by_hand(rows, items)
    df = docs_of(rows)
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not x[-1] for x in hits_by_hand(rows, items))


def test_decontamination_of_repeated_words(spark, docs_of):
    """Long runs of one word, or of a phrase, cost no more than other words."""
    import time

    items = [(1, "rep " * 5000), (2, "one two " * 3000), (3, "rep " * 13)]
    rows = [(1, "rep " * 20_000), (2, "two one " * 10_000), (3, "rep " * 12), (4, "Lead rep " + "one two " * 7)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    block = decontaminate.Block([str(i) for i, _ in items], [t.encode() for _, t in items], 13)
    block.pick(np.zeros(len(block.values), dtype=np.int64))
    words = decontaminate.Words([t.lower().encode() for _, t in rows])
    begun = time.time()
    block.hits(words)
    assert time.time() - begun < 5 and len(block.at) == 3
    assert rows_of(decontaminate.digests(docs_of(rows), bench)) == hits_by_hand(rows, items)


def test_words_of_equal_polynomials_differ():
    """Thue-Morse words have equal polynomials modulo 2**64, whatever the base."""
    from namefold.llm.common import word_hashes

    one = bytes(97 + bin(k).count("1") % 2 for k in range(4096))
    other = bytes(195 - x for x in one)
    a, b, c = word_hashes(one + b" " + other + b" " + one)[2].tolist()
    assert a == c != b


def test_decontamination_without_items(spark, docs_of):
    out = decontaminate.digests(docs_of(ODD), spark.createDataFrame([], "item_id long, text string"))
    assert rows_of(out) == hits_by_hand(ODD, [])


# Packing.


def test_word_tokens_equal_the_tokenizer():
    words = packing.WordTokens(word_tokenizer())
    odd = ["İstanbul ß ẞ it's I'LL <|endoftext|>x á é​x ½ ² naïve.. a,b! don't 'tis", "a\xa0b\x1cc \t\r\n x", " ", "", "\n\n", "ÅÉÜ×÷Øø ÿŸ", "x" * 500, "ﬁn ǅ I.D.s 's're"]
    for text in odd + [t for _, t in ODD if t]:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs_of):
    rows = ODD + [(1000 + k, "some words of a text " * (k * 37 % 900)) for k in range(80)]
    out = packing.packed(docs_of(rows), word_tokenizer(), keep_ids=True).collect()
    tokenizer = packing.WordTokens(word_tokenizer()).tokenizer
    want = sorted((str(i), tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    pieces = defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 4096 and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
        pieces[str(r["doc_id"])].append((r["piece"], tuple(ids)))
    got = []
    for i, parts in pieces.items():
        copies = sum(p == 0 for p, _ in parts)
        got += [(i, sum((p for _, p in sorted(set(parts))), ()))] * copies
    assert sorted(got) == want
    used = defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in used.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) <= -(-sum(r["length"] for r in out) // 4096) + 1


def test_best_two_fit_replaces_the_smallest():
    # Greedy takes 6, 3 and leaves 1; the 3 goes for 2 and 2, which fill its gap.
    sequence, offset = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sequence[0] == sequence[2] == sequence[3] != sequence[1] and sorted(offset[[0, 2, 3]]) == [0, 6, 8]


def test_best_two_fit_of_lone_pieces():
    # Greedy leaves 7, 4, 4 and 4 in three sequences of 10; no gap takes a third piece.
    assert packing.best_two_fit(np.array([7, 4, 4, 4]), 10)[0].max() == 2
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 101, 500), rng.integers(30, 75, 500)):
        sequence, offset = packing.best_two_fit(lengths, 100)
        assert len({*zip(sequence.tolist(), offset.tolist())}) == 500 and np.bincount(sequence, weights=lengths).max() <= 100
        assert sequence.max() + 1 == min(len(packing._filled(lengths, 100, k)) for k in (1, 2))


# Chat.


def test_chat_round_trip(spark):
    control = ["\\### Assistant: </turn> ok", "###", "####", "\\", "\\\\###", "</turn>\n", "</turn></turn>", "", None, "é\u2028x", ":", "a: b"]
    rows = [(k % 5, k // 5, role, text) for k, (role, text) in enumerate((r, t) for t in control for r in ("user", "assistant", "odd: ### role", None))]
    rows += [(9, 1, "assistant", "tie"), (9, 1, "assistant", "tie"), (9, None, "user", "first"), (None, 0, "user", "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0], v[1].encode(), v[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(df).collect()} == want
    for r in chat.formatted(df).collect():
        assert len(chat.parse(r["formatted"].encode())) == want[r["conv_id"]][0]


def test_chat_rejects_other_text():
    for bad in (b"x", b"### user: text", b"### user text</turn>\n", b"### user: a</turn>\nrest"):
        with pytest.raises(ValueError):
            chat.parse(bad)
    assert chat.parse(b"") == []


# WARC.


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(k, f"http://h/{k}\r\n%", ["<p>a</p>", None, "", "<b>é</b>" * 40][k % 4], "x") for k in range(30)] + [(3, "again", "<b>é</b>" * 40, "x"), (None, None, "alone", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(2)
    archives = warc.write(pages, str(tmp_path / "out"))
    assert archives.count() > 2
    got = sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.read(archives).collect()), key=str)
    first = defaultdict(list)
    for i, _, h, _ in rows:
        first[h or ""].append(i)
    want = []
    for i, u, h, _ in rows:
        body = (h or "").encode()
        least = min((x for x in first[h or ""] if x is not None), default=None)
        revisit = i != least
        want.append((i, u or "", len(body), warc.payload_digest(body), "revisit" if revisit else "response", least if revisit else None, None if revisit else bytearray(body)))
    assert got == sorted(want, key=str)
    small = warc.read(warc.write(pages, str(tmp_path / "min"), min_bytes=10_000))
    assert {r["record_type"] for r in small.collect()} == {"response"}
    empty = warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(empty).count() == 0


def test_warc_checks_what_it_reads():
    good = warc.record(1, "http://h/", b"payload", None, False)
    data = warc.archive([good, good])
    assert [warc.parse_record(f)["payload"] for f in warc.frames(data)] == [b"payload"] * 2
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))
    with pytest.raises(ValueError):
        list(warc.frames(data[8:]))
    for bad in (good.replace(b"payload", b"Payload"), good[:-1], good.replace(b"WARC/1.1", b"WARC/0.1"), good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# URLs.


def test_urls(spark):
    assert url_filter.split_url("HTTP://A.Example.COM:80/en/x?y#z") == ("a.example.com:80", "/en/x")
    assert url_filter.split_url("x://h#f") == ("h", "") and url_filter.split_url("nohost/en/") == ("", "") and url_filter.split_url(None) == ("", "")
    fit = lambda h, p: url_filter.fitting(h, p, url_filter.RULES)
    assert fit("a.example.com", "/en/7") == ("example.com/en/7", "allow") and fit("example.com", "/en/8") == ("com/en/", "block")
    assert fit("xexample.com", "/en/7") == ("com/en/", "block") and fit("com", "/en/") == ("com/en/", "block") and fit("example.org", "/de/") == (None, None)
    rng = np.random.default_rng(0)
    rows = [(k, f"http://s{rng.integers(99)}.{'shop' if k % 2 else 'news'}.{'net' if k % 2 else 'com'}/{'de' if k % 2 else 'en'}/{k}") for k in range(400)]
    rows += [(1000 + k, f"http://s{k}.{'shop' if k % 2 else 'news'}.{'net' if k % 2 else 'com'}/fr/{k}") for k in range(100)] + [(2000, None), (2001, "x"), (2001, "x"), (None, "http://a.net/de/")]
    out = {(r["page_id"], r["host"]): r for r in url_filter.judged(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, rule string")).collect()}
    assert len(out) == len(rows) - 1
    new = [r for (i, _), r in out.items() if i is not None and 1000 <= i < 2000]
    assert all(r["rule"] is None for r in new) and np.mean([(r["verdict"] == "allow") == bool(r["page_id"] % 2) for r in new]) > 0.95
    assert out[2000, ""]["score"] == 0 and out[None, "a.net"]["rule"] == "net/de/"


def url_scores_by_hand(rows, names):
    """Scores of names by counts of the rows (page, url) with URLs under net/de/ as allowed and under com/en/ as blocked."""
    n = (defaultdict(int), defaultdict(int))
    grams = lambda x: [(k, (b"\0" * 5 + x)[i + 5 - k : i + 5], x[i : i + 1]) for i in range(len(x)) for k in range(6)]
    for page, url in rows:
        if zlib.crc32(str(page).encode()) % 5 and ("net/de" in url or "com/en" in url):
            for k, context, byte in grams(url[7:].encode()):
                for key in ((k, context), (k, context, byte)):
                    n["com/en" in url][key] += 1
    out = []
    for name in names:
        logs = [0.0, 0.0]
        for side in (0, 1):
            for k, context, byte in grams(name):
                p = 1 / 256 if k == 0 else p
                p = (n[side][k, context, byte] + 2 * p) / (n[side][k, context] + 2)
                logs[side] += np.log(p) if k == 5 else 0
        out.append((logs[0] - logs[1]) / max(len(name), 1))
    return out, len({key for side in n for key in side if len(key) == 2 and key[0] == 5})


def test_url_scores_equal_exact_counts(spark, monkeypatch):
    """Over more than 65,536 contexts, in many chunks, with a repeated row, an empty name and a long one."""
    monkeypatch.setattr(url_filter, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(url_filter, "SLICE_BYTES", 20_000)
    rng = np.random.default_rng(0)
    rows = [(k, f"http://a.{'net/de' if k % 2 else 'com/en'}/{rng.integers(16**10):010x}") for k in range(20_000)]
    asked = [(30_000 + k, f"http://b.org/fr/{rng.integers(16**10):010x}") for k in range(50)] + [(40_000, "http://b.org/" + "xyz" * 10_000), (40_001, "none"), (30_000, "http://b.org/fr/twice"), (30_000, "http://b.org/fr/twice")]
    out = url_filter.judged(spark.createDataFrame(rows + asked, "page_id long, url string")).where("page_id >= 30000").collect()
    names = [(r["host"] + r["path"]).encode() for r in out]
    want, contexts = url_scores_by_hand(rows, names)
    assert contexts > 65_536 and sorted(r["page_id"] for r in out) == sorted(i for i, _ in asked)
    assert [r["score"] for r in out] == pytest.approx(want, abs=1e-9)


def test_urls_without_rules_decided(spark):
    out = url_filter.judged(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")).collect()
    assert [(r["verdict"], r["score"]) for r in out] == [("allow", 0.0)]


# Learned scores.


def test_quality_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for operator, label, modulus, held, floor in ((quality, "quality", 5, 0, 0.95), (toxicity, "toxic", 3, 1, 0.9)):
        rows = operator.classify(docs, labels).join(labels, "doc_id").collect()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) for r in rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= operator.THRESHOLD) for r in rows)
        asked = [r for r in rows if r["held_out"]]
        assert np.mean([r["predicted"] == r[label] for r in asked]) >= floor


def labelled_texts():
    rng = np.random.default_rng(2)
    words = [f"w{rng.integers(10**6)}" for _ in range(60)]
    texts = [" ".join([*rng.choice(words, 12), *["Nasty!"] * (k % 3 == 0), *["word", "word"] * (k % 2)]) for k in range(120)]
    return texts, [int(k % 3 == 0) for k in range(120)]


def test_quality_scores_by_hand():
    """The mean over all tokens of the means of their parts' vectors, through the logistic."""
    texts, labels = labelled_texts()
    values, bias = quality.train(texts, labels)
    score = quality.scorer((values, bias))
    for text in [*texts[:20], "unseen ünseen", "", "a a a"]:
        tokens = text.split()
        tokens += ["\0repeat"] * sum(a == b for a, b in zip(tokens, tokens[1:]))
        means = []
        for t in tokens:
            grams = [b"\0repeat"] if t == "\0repeat" else [b"<" + t.encode() + b">", *sorted({(b"<" + t.encode() + b">")[i : i + n] for n in (2, 3) for i in range(len(t.encode()) + 3 - n)})]
            means.append(sum(values[zlib.crc32(g) % len(values)] for g in grams) / len(grams))
        z = bias + (sum(means) / len(means) if means else 0.0)
        assert score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_scores_by_hand():
    """The machine's sum over all pairs of terms, one by one."""
    texts, labels = labelled_texts()
    buckets, weight, vector, bias = toxicity.train(texts, labels)
    at = {b: k for k, b in enumerate(buckets.tolist())}
    score = toxicity.scorer((buckets, weight, vector, bias))
    for text in [*texts[:20], "unseen words", ""]:
        counts = defaultdict(int)
        for word in text.lower().split():
            word = word.strip(toxicity.MARKS)
            for form in [b"w" + word.encode()] * bool(word) + [b"p" + word[:n].encode() for n in (4, 5) if len(word) > n]:
                b = zlib.crc32(form) % toxicity.BUCKETS
                if b in at:
                    counts[at[b]] += 1
        terms = [(k, 1 + np.log(n)) for k, n in counts.items()]
        z = bias + sum(weight[k] * x for k, x in terms) + sum(vector[i] @ vector[j] * x * y for p, (i, x) in enumerate(terms) for j, y in terms[:p])
        assert score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_sample_is_bounded_in_rows_and_bytes(spark, docs_of):
    from pyspark.sql import functions as F

    from namefold.llm.learning import labelled_sample

    rows = [(k, f"text {k} " + "x" * (10 * k)) for k in range(20)] + [(3, "another text of three"), (3, "text 3 again"), (30, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(25)] + [(4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    texts, found = labelled_sample(docs_of(rows), labels, "toxic", F.lit(True), 100)
    assert len(texts) == 20 and min(t for i, t in rows if i == 3) in texts and sum(found) == 11
    few, _ = labelled_sample(docs_of(rows), labels, "toxic", F.lit(True), 100, most_bytes=300)
    assert few and sum(len(t.encode()) for t in few) <= 300 and set(few) < set(texts)
    assert len(labelled_sample(docs_of(rows), labels, "toxic", F.lit(True), 4)[0]) <= 4


def test_scores_of_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (4, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for operator in (quality, toxicity):
        for some in (labels, labels.limit(0)):
            out = operator.classify(docs_of(ODD), some).collect()
            assert len(out) == len(ODD) and all(r["score"] == 0.5 for r in out)
    df = docs_of(ODD)
    assert toxicity.reject(df, labels.limit(0)).columns == df.columns


def test_terms_that_matter_together():
    """Neither word alone is toxic, both together are: additive weights can't tell, pairs can."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(600):
        x, y = rng.random(2) < 0.5
        texts.append(" ".join(["filler", "words"] + ["zork"] * bool(x) + ["blat"] * bool(y)))
        labels.append(int(x == y))
    score = toxicity.scorer(toxicity.train(texts, labels))
    assert np.mean([(score(t) >= 0.5) == bool(v) for t, v in zip(texts, labels, strict=True)]) > 0.95


def test_terms_that_matter_together_in_a_large_vocabulary():
    """As above, among thousands of other words; each of the two is as frequent in clean texts as in toxic ones."""
    rng = np.random.default_rng(5)
    words = [f"{rng.integers(10**9):x}q{k}" for k in range(5000)]
    texts, labels = [], []
    for k in range(3600):
        x, y = k % 4 in (0, 1), k % 4 in (0, 2)
        texts.append(" ".join([*rng.choice(words, 20, replace=False), *["zorkish"] * x, *["blatant"] * y]))
        labels.append(int(x == y))
    score = toxicity.scorer(toxicity.train(texts[:3000], labels[:3000]))
    assert np.mean([(score(t) >= 0.5) == bool(v) for t, v in zip(texts[3000:], labels[3000:], strict=True)]) > 0.95


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_empty_tables(spark, docs_of, name):
    none = docs_of([(1, "x")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    operator = {"quality": quality, "toxic": toxicity}[name]
    assert operator.classify(none, labels).count() == 0


def test_empty_documents(spark, docs_of):
    none = docs_of([(1, "x")]).limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for out in (exact_dedup.deduplicate(none), line_dedup.digests(none), jaccard_join.join(none), decontaminate.digests(none, bench), packing.packed(none, word_tokenizer()), jaccard_join.one_of_each(none)):
        assert out.count() == 0
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


