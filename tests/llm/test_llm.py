"""Corpus operators against brute force on small tables with every awkward case."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyloom.llm import bpe, chat_format, exact_dedup, lm_scores, mixing, near_dedup, quality_rules, substring_dedup, token_counts, url_filter
from rallyloom.llm.components import connected_components
from rallyloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, vocabulary=200):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, blanks, nulls, a very long text, a repeated row."""
    base = [words(120, i) for i in range(6)]
    passage = words(60, 99)
    rows = [(i, " ".join(w), "en", f"s{i % 2}") for i, w in enumerate(base)]
    rows += [(10 + i, " \n".join(base[0]) + " " * i, "en", "s0") for i in range(5)]
    rows += [(20 + i, " ".join([*base[1][: 40 + i], "Changed", *base[1][41 + i :]]), "en", "s1") for i in range(5)]
    rows += [(30 + i, " ".join(words(70, 200 + i) + passage + words(30, 300 + i)), "en", "s0") for i in range(3)]
    rows += [(40, "", "en", "s0"), (41, None, None, None), (42, " \t\n ", "en", None), (43, "one", "fr", "s1"), (44, "ONE", "fr", "s1"), (45, "one two", "fr", "")]
    rows += [(50, " ".join(words(6000, 7, 3000)), "en", "s1"), (51, " ".join(words(80, 8, 2)), "en", "s0"), (3, " ".join(base[3]), "en", "s1"), (None, " ".join(words(90, 61)), "en", "s0")]
    rows += [(60, "don't <|endoftext|>  x  y\n\n　z Ünï 🙂 日本", "de", "s1"), (61, "* # $ lines\n* # $ lines\n\nlast", "de", "s1")]
    return [(d, t, l, s, len(t or "")) for d, t, l, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    extra = {"kept": F.lit(7), "size": F.lit("x"), "digest": F.lit(None).cast("string"), "block": F.lit(1)}
    return spark.createDataFrame(corpus(), DOCS).repartition(3).withColumns(extra).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t, *_ in corpus():
        groups[norm(t)].append((-len(t or ""), d is None, d or 0, d))
    want = []
    for d, t, *_ in corpus():
        keep = min(groups[norm(t)])[3]
        want.append((d, keep, len(groups[norm(t)]), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(exact_dedup.exact_duplicates(docs, first=3, wider=3), *columns) == sorted(want, key=repr)
    assert rows_of(exact_dedup.exact_duplicates(docs), *columns) == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns


def test_mixing(docs, empty):
    got = mixing.mix_documents(docs, params=mixing.MixParams(rank_rows=5)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    by = defaultdict(int)
    for _, t, _, s, _ in corpus():
        by[s] += size(t)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight, cap = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: 3 * by[s] for s in order}
    fixed, total = {}, sum(by.values())
    while True:
        free = [s for s in order if s not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * share > cap[s]]
        if not above:
            break
        fixed |= {s: cap[s] for s in above}
    want = {s: float(fixed.get(s, weight[s] * share)) for s in order}
    assert len(got) == len(corpus())
    source = {d: s for d, _, _, s, _ in corpus()}
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == by[source[r.doc_id]] and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in order:
        longest = max(size(t) for _, t, _, x, _ in corpus() if x == s)
        assert abs(taken[s] - want[s]) <= max(30, 0.1 * longest)  # whole copies only
    again = mixing.mix_documents(docs, params=mixing.MixParams(rank_rows=5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_documents(empty).count() == 0
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_token_counts(docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    library = token_counts.load_tokenizer(path)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = {(r.doc_id, r.n_bytes): r for r in token_counts.count_tokens(docs, path, limit=100).collect()}
    for d, t, *_ in corpus():
        r = got[d, len((t or "").encode())]
        assert (r.n_tokens, r.over_limit) == (n(t), n(t) > 100)
        assert r.fit_chars == len(t or "") if not r.over_limit else n(t[: r.fit_chars]) <= 100
    assert token_counts.count_tokens(empty, path).count() == 0
    table = token_counts.prefix_table(path)
    for text in ["don't stop  <|endoftext|>!\n\n''re  x", "Ünï 日本 🙂 ét", "", "it's 'r 're 'research they'll'd", "e\u0301a\u0308\u0323x 각a\u1161 İΣ", "a<|endoftext|>b<|endoftext", "x\u3000y\u00a0z\x1cw"]:
        assert table.every_prefix(text.encode()).tolist() == [n(text[:k]) for k in range(len(text) + 1)], text
    text = dict((d, t) for d, t, *_ in corpus())[30]
    stored = token_counts.prefix_counts(docs, path).where("doc_id = 30").select("counts", token_counts.tokens_at(F.col("counts"), 50).alias("a"), token_counts.longest_fit(F.col("counts"), 9).alias("f"))
    row = stored.first()
    assert row.counts[::40] == [n(text[:k]) for k in range(0, len(text) + 1, 40)] and row.a == n(text[:50])
    assert row.f == max(k for k in range(60) if n(text[:k]) <= 9)
    assert token_counts.prefix_counts(empty, path).count() == 0


def test_prefixes_of_many_words():
    """The dynamic programme against the library: every prefix of random strings."""
    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(11)
    library, table = token_counts.load_tokenizer(path), token_counts.PrefixTable(path)
    table._by_library = None  # not called: the programme alone
    signs = [*"aeinorstthl", "the", "ing", "tion", "'", "s", "re", "ve", "l", "!", "?!", "9", "é", "日", "本語", "🙂", "Ü", "ß", "я", "ш", "हि", "ก็", "_", "--", "aaaa", "..."]
    words = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + ["a" * 60, "ab" * 40, "!" * 70, "haha" * 15]
    for w in words:
        assert table.inside(w.encode()).tolist() == [len(x.ids) for x in library.encode_batch([w[:k] for k in range(len(w) + 1)], add_special_tokens=False)], w


def test_very_long_words(spark):
    """100,000 code points without a space: bounded memory, exact cut."""
    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(12)
    letters = [chr(c) for c in range(0x4E00, 0x5200)]
    texts = ["".join(rng.choice(letters) for _ in range(100_000)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))]
    library = token_counts.load_tokenizer(path)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"), path).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == n(t) and n(t[: got[i].fit_chars]) <= 2048 < n(t[: got[i].fit_chars + 1])


@pytest.mark.parametrize("width,block,fanout", [(35, 1 << 20, 512), (35, 4000, 512), (3, 2000, 3)])
def test_substring_dedup(docs, empty, width, block, fanout):
    seen = Counter()
    split = [(d, WORD.findall(t or "")) for d, t, *_ in corpus()]
    for _, w in split:
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    want = []
    for d, w in split:
        cut = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                cut.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in cut)
        want.append((d, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.remove_repeats(docs, width, block_bytes=block, with_text=True, fanout=fanout)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert got.where("size(spans) > 0 and n_removed <> aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("block,fanout", [(1 << 20, 512), (3000, 4)])
def test_bpe(docs, empty, block, fanout):
    path = tokenizer_path("byte_bpe_50k.json")
    library = bpe.load_tokenizer(path)
    want = []
    for d, t, *_ in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = bpe.encode_documents(docs, path, with_ids=True, block_bytes=block, fanout=fanout)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    texts = bpe.decode_ids(got, path)
    assert rows_of(texts, "doc_id", "text") == sorted(((d, t or "") for d, t, *_ in corpus()), key=repr)
    assert bpe.encode_documents(empty, path).count() == 0


def test_pieces_encode_alone():
    library, rng = bpe.load_tokenizer(tokenizer_path("byte_bpe_50k.json")), random.Random(5)
    signs = ["a", "B", "é", "日", "1", "'", "s", "!", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", " ", "🙂", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        parts = bpe.split_pieces(text)
        assert "".join(parts) == text
        assert [i for p in parts for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_url_filters(spark):
    urls = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "http://x.com/fr/", "http://x.com/de/", "http://bad.net/p", "http://good.net", "http://sub.bad.net/?a/b", None, "no scheme", "http://x.org", "http://x.org/", "http://xorg/", "ftp://bad.net#f", "http://comx/fr/"]
    urls += [f"http://h{i}.net/" for i in range(400)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://bad.net/", "y")], "page_id bigint, url string, host string")
    df = df.withColumns({"key": F.lit(1), "listed": F.lit("x"), "fit": F.lit(0), "_url": F.lit(0)})
    blocked = ["bad.net", "", "bad.net", None, "elsewhere.org"] + [f"h{i}.net" for i in range(400) if i % 10 == 7]
    keys = spark.createDataFrame([(k,) for k in blocked], "key string")
    some = url_filter.CascadeParams
    for params in (some(bits_per_key=2, hashes=1), some(), some(max_filter_bytes=10), some(max_filter_bytes=1, max_cascades=2)):
        got = {r.page_id: r for r in url_filter.filter_pages(df, keys, params=params).collect()}
        assert len(got) == len(urls) + 1
        verdicts = [got[i].verdict for i in range(14)]
        assert verdicts == ["block", "block", "allow", "block", "block", "allow", "block", "block", "block", "allow", "allow", "allow", "block", "allow"]
        assert [got[i].rule for i in range(4)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/"] and got[9].rule is None and got[10].rule == "org/"
        assert (got[1].host, got[1].path, got[7].host, got[6].path) == ("example.org", "/en/12", "", "/")
        assert all(got[14 + i].listed == (i % 10 == 7) for i in range(400))
    assert url_filter.filter_pages(df.limit(0), keys).count() == 0
    assert {r.verdict for r in url_filter.filter_pages(df.where("page_id = 4"), keys.limit(0)).collect()} == {"allow"}


def test_quality_rules(docs, empty):
    got = {(r.doc_id, r.word_chars): r for r in quality_rules.judge_documents(docs).collect()}
    for d, t, *_ in corpus():
        w = WORD.findall(t or "")
        r = got[d, sum(map(len, w))]
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)), d
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert quality_rules.judge_documents(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == sorted(((r.doc_id,) for r in quality_rules.judge_documents(docs).where("kept").collect()), key=repr)


def test_bad_hosts_lose_their_documents(spark):
    rows = [(i, "bad" if i < 40 else "good", i % 40 >= (36 if i < 40 else 2)) for i in range(80)]
    counted = spark.createDataFrame([(i, h, not ok) for i, h, ok in rows], "doc_id bigint, source string, base_failed boolean")
    verdict = {r.host: r.host_ok for r in quality_rules.host_verdicts(counted).collect()}
    assert verdict == {"bad": False, "good": True}


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, empty, width):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for d, t, *_ in corpus():
        w = WORD.findall(low(t))
        sets.append((d, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    label = [d for d, _ in sets]
    big = 10**9
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b) and (big if label[i] is None else label[i]) > (big if label[j] is None else label[j]):
                    label[i], changed = label[j], True
    want = [(d, len(s), c, d == c) for (d, s), c in zip(sets, label)]
    got = near_dedup.near_duplicates(docs, width=width)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    assert near_dedup.near_duplicates(empty, width=width).count() == 0


def test_near_dedup_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = words(200, 1, 5000)
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)] + [(100 + i, " ".join(words(150, 50 + i, 5000))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()}
    assert got == {i: 0 for i in range(40)} | {100 + i: 100 + i for i in range(20)}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (5, 5)] + [(1000, 1000 + rng.randrange(1, 50)) for _ in range(60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[300] == 100 and {r for n, r in got.items() if n >= 1000} == {1000}


@pytest.mark.parametrize("order,block,fanout", [(1, 1 << 20, 512), (2, 3000, 512), (3, 1000, 6)])
def test_lm_scores(docs, empty, order, block, fanout):
    split = [(d, WORD.findall(t or "")) for d, t, *_ in corpus()]
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    every = [sum((grams(w, k) for _, w in split), Counter()) for k in range(1, order + 1)]
    total = sum(len(w) for _, w in split)
    want = {}
    for d, w in split:
        own = [grams(w, k) for k in range(1, order + 1)]
        left = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        value = 0.0
        for i in range(len(w)):
            factor, k = 1.0, min(order, i + 1)
            while k > 1 and left(tuple(w[i - k + 1 : i + 1])) <= 0:
                factor, k = factor * 0.4, k - 1
            g = tuple(w[i - k + 1 : i + 1])
            value += np.log(factor * (left(g) / left(g[:-1]) if k > 1 else (left(g) or 0.5) / (total - len(w) + 0.5)))
        want[d, len(w)] = value
    got = lm_scores.score_documents(docs, order, block_bytes=block, fanout=fanout).collect()
    assert len(got) == len(split)
    for r in got:
        assert abs(r.log_prob - want[r.doc_id, r.n_words]) < 1e-6 * max(1, abs(r.log_prob))
        assert (r.mean_log_prob is None) == (r.n_words == 0)
    assert lm_scores.score_documents(empty).count() == 0


CALLS = "conv_id bigint, turn bigint, role string, text string, call_id string, tool string, arguments string, result_of string, uses array<string>"
TOOLS = {"add": (chat_format.Field("a", "integer"), chat_format.Field("b", "number", False)), "none": ()}


def test_chat_format(spark):
    rows = [
        (1, 0, "user", "hi \"you\"\n", None, None, None, None, None), (1, 2, "assistant", None, "c1", "add", '{"b": 1.5, "a": 2}', None, None),
        (1, 1, "tool", "3.5", None, None, None, "c1", None), (1, 3, "tool", "again", None, None, None, "c1", None), (1, 4, "tool", "?", None, None, None, "zz", None),
        (1, 5, "assistant", "", "c2", "add", '{"a": "x", "c": [1]}', None, ["c1"]), (1, 6, "assistant", "", "c3", "mul", "{}", None, ["c2", "gone"]),
        (1, 7, "assistant", "", "c1", "add", '{"a": 1}', None, None), (1, 8, "assistant", "", "c4", "add", "not json", None, ["c5"]), (1, 9, "assistant", "", "c5", "none", "{}", None, ["c4"]),
        (2, 0, "assistant", "", "c1", "none", "{}", None, []), (None, None, None, None, None, None, None, None, None),
    ]
    got = chat_format.format_messages(spark.createDataFrame(rows, CALLS), TOOLS).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    assert [at[1, t].status for t in range(10)] == ["message", "linked", "answered", "repeated", "orphan", "invalid", "invalid", "repeated", "invalid", "open"]
    assert at[1, 5].errors == ["missing a", "type of a", "unknown c"][1:] and at[1, 6].errors == ["unknown tool"] and at[1, 8].errors == ["not an object"]
    assert [at[1, t].level for t in (2, 5, 6, 8, 9)] == [0, 1, 2, -1, -1] and at[2, 0].status == "open" and at[None, None].status == "message"
    assert (at[1, 1].at, at[1, 1].step) == (2, 1)
    line = json.loads(at[1, 2].line)
    assert at[1, 2].line.startswith('{"arguments":{"a":2,"b":1.5},"call_id":"c1","content":""') and line["tool"] == "add"
    assert json.loads(at[1, 0].line) == {"content": 'hi "you"\n', "role": "user"}
    assert chat_format.format_messages(spark.createDataFrame([], CALLS), TOOLS).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "que"), (1, 1, "assistant", "a"), (1, 2, None, None), (1, 3, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.turn: r.status for r in chat_format.format_messages(chat_format.conversation_messages(turns), chat_format.REPLY).collect()}
    assert got == {0: "answered", 1: "linked", 2: "message", 3: "orphan"}


def test_chat_levels(spark):
    """Chains, branches and circles against a depth-first search; rows that repeat."""
    rng = random.Random(9)
    uses = {i: {i - 1} if i % 50 else set() for i in range(1, 300)}  # chains of 50
    uses |= {i: {rng.randrange(1, i) for _ in range(rng.randrange(3))} for i in range(300, 360)}
    uses |= {400: {401}, 401: {402}, 402: {400}, 403: {402}, 404: {403, 1}, 405: {405}, 406: {999, 49}}

    def level(i, path=()):
        if i in path:
            return None
        below = [level(j, (*path, i)) for j in uses[i] if j in uses]
        return None if None in below else 1 + max(below, default=-1)

    calls = spark.createDataFrame([("c1", str(i), [str(j) for j in js]) for i, js in uses.items()] + [("null", "1", ["2"]), ("null", "2", None)], "conv string, id string, uses array<string>")
    got = {(r.conv, r.id): r.level for r in chat_format.call_levels(calls).collect()}
    want = {("c1", str(i)): level(i) for i in uses}
    assert {k: v for k, v in got.items() if k[0] == "c1"} == {k: -1 if v is None else v for k, v in want.items() if v != 0}
    assert got["null", "1"] == 1 and ("null", "2") not in got


def test_chat_repeats_nulls_and_clashes(spark):
    row = (1, 0, "assistant", "x", "c1", "none", "{}", None, None)
    answer = (1, 1, "tool", "y", None, None, None, "c1", None)
    null = (None, 0, "assistant", "x", "c1", "none", "{}", None, None)
    rows = spark.createDataFrame([row, row, answer, answer, answer, null], CALLS)
    rows = rows.withColumns({c: F.lit(5) for c in ("_first", "call", "conv", "key", "level", "answer", "c1")})
    got = Counter((r.conv_id, r.status) for r in chat_format.format_messages(rows, TOOLS).collect())
    assert got == {(1, "answered"): 1, (1, "repeated"): 3, (1, "linked"): 1, (None, "open"): 1}
    named = spark.createDataFrame([("null", 0, "a", "", "c1", "none", "{}", None, None), (None, 0, "a", "", "c1", "none", "{}", None, None)], CALLS.replace("conv_id bigint", "conv_id string"))
    assert [r.status for r in chat_format.format_messages(named, TOOLS).collect()] == ["open", "open"]


def test_rows_stay_and_not_ids(spark):
    """Null and repeated ids, rows equal in every column: each group keeps exactly one row."""
    long = " ".join(words(80, 1))
    rows = [(2, long), (2, long + " "), (None, long), (None, "other " + " ".join(words(80, 2))), (2, "third " + " ".join(words(80, 3))), (7, "x y"), (7, "x y"), (None, None), (None, "")]
    extra = {c: F.lit(c) for c in ("row", "key", "_kept_id", "_copies", "_copy", "doc", "none")}
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, source string").withColumns(extra)
    exact = exact_dedup.drop_duplicates(df)
    assert exact.columns == df.columns
    assert rows_of(exact, "doc_id", "text") == sorted([rows[1], *rows[3:6], max(rows[7:], key=lambda r: exact.where("text is null").count() == (r[1] is None))], key=repr)
    near = near_dedup.drop_near_duplicates(df)
    assert near.columns == df.columns and near.count() == 6 and near.where(F.col("text").startswith(long)).count() == 1
    copies = [(1, "a b c")] * 50 + [(2, "d e f g")] * 50
    twice = spark.createDataFrame([(i, t, f"s{i}") for i, t in copies], "doc_id bigint, text string, source string").withColumns(extra)
    mixed = mixing.mix_documents(twice).collect()
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += r.taken
    given = Counter()
    for r in mixing.take_mix(twice).collect():
        given[r.doc_id] += len(r.text.split())
    assert given == taken and abs(taken[1] - [r.target for r in mixed if r.doc_id == 1][0]) <= 3


def test_rates_tilt_with_size(spark):
    """Rates are exp(multiplier * size) up to the bound: short documents of a cut source stay, long ones go first."""
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), f"s{i % 4}") for i in range(400)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for s in range(4):
        mine = {r.size: r for r in got if r.doc_id % 4 == s}
        open_ = [r for r in mine.values() if r.rate < 3]
        slopes = [np.log(r.rate) / r.size for r in open_]
        assert len(open_) < 10 or max(slopes) - min(slopes) < 1e-9
        ratio = open_[0].target / open_[0].source_size
        assert ratio == 1 or (slopes[0] > 0) == (ratio > 1)
        assert len({round(r.rate, 6) for r in open_}) > 5 or abs(ratio - 1) < 1e-9
        words_ = sum(r.rate * r.size for r in got if r.doc_id % 4 == s)
        assert abs(words_ - open_[0].target) < 1e-6 * open_[0].target


def test_large_groups_meet_their_pivot(spark, monkeypatch):
    """Groups of many blocks, with members that only others than the pivot link."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = random.Random(6)
    rows = []
    for g in range(3):
        base = words(150, 70 + g, 4000)
        for i in range(30):
            w = base[:]
            for j in range(rng.choice((1, 2, 6, 9))):
                w[rng.randrange(150)] = f"x{g}.{i}.{j}"
            rows.append((g * 100 + i, " ".join(w)))
    sets = [(d, set(zip(t.split(), t.split()[1:]))) for d, t in rows]
    label = {d: d for d, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if 100 * len(x & y) >= 80 * len(x | y) and label[b] < label[a]:
                    label[a], changed = label[b], True
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()}
    assert got == label


def test_rejected_hosts_join_by_salt(spark):
    """More rejected hosts than may be broadcast: the same rows."""
    good, bad = " ".join(words(80, 5)), "too short"
    rows = [(i, good if i % 10 else bad, "good") for i in range(60)] + [(100 + i, bad if i % 10 else good, "bad") for i in range(60)] + [(300, good, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(1) for c in ("row", "words", "_words", "host", "salt", "windows", "n_words")})
    want = sorted((r[0],) for r in rows if r[1] == good and r[2] != "bad")
    for params in (quality_rules.QualityParams(), quality_rules.QualityParams(max_broadcast_hosts=0)):
        kept = quality_rules.keep_good(df, params=params)
        assert kept.columns == df.columns and rows_of(kept, "doc_id") == sorted(want, key=repr)
    judged = quality_rules.judge_documents(df)
    assert rows_of(judged.where("kept"), "doc_id") == sorted(want, key=repr) and "_words" in judged.columns and judged.where("words <> 1").count() == 0
