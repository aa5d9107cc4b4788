"""run() of the corpus pipeline, row by row, against plain Python."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rallyloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def quality(rows):
    failed = {}
    for i, r in rows.items():
        w = WORD.findall(r.text or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {q for k, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] > 1 for q in (k, k + 1, k + 2)}
        failed[i] = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    hosts = defaultdict(list)
    for i, r in rows.items():
        if r.source is not None:
            hosts[r.source].append(failed[i])
    docs = sum(map(len, hosts.values()))
    mean = sum(map(sum, hosts.values())) / docs
    between = sum(sum(h) ** 2 / len(h) for h in hosts.values()) / docs - mean**2 - mean * (1 - mean) * len(hosts) / docs
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1000.0) if between > 1e-12 else 1000.0
    bad = {s for s, h in hosts.items() if (sum(h) + mean * strength) / (len(h) + strength) > 0.5}
    return {i: r for i, r in rows.items() if not failed[i] and r.source not in bad}


def exact(rows):
    groups = defaultdict(list)
    for i, r in rows.items():
        groups["".join(WORD.findall(r.text or ""))].append((-len(r.text or ""), i))
    kept = {min(g)[1] for g in groups.values()}
    return {i: r for i, r in rows.items() if i in kept}


def near(rows):
    sets = {}
    for i, r in rows.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label, changed = {i: i for i in rows}, True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: r for i, r in rows.items() if label[i] == i}


def mix(rows):
    size = {i: len(WORD.findall(r.text or "")) for i, r in rows.items()}
    total = defaultdict(int)
    for i, r in rows.items():
        total[r.source] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while True:
        free = [s for s in order if s not in fixed]
        share = (sum(total.values()) - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * share > 3 * total[s]]
        if not above:
            break
        fixed |= {s: 3 * total[s] for s in above}
    copies = {}
    for s in order:
        target = float(fixed.get(s, weight[s] * share))
        cells = Counter(size[i] for i, r in rows.items() if r.source == s and size[i])
        low, high = -100.0, 100.0
        for _ in range(200):
            tilt = (low + high) / 2
            if sum(n * z * min(3.0, math.exp(min(tilt * z, 50))) for z, n in cells.items()) < target:
                low = tilt
            else:
                high = tilt
        want = {z: (3.0 if target >= 3 * total[s] else round(min(3.0, math.exp(min(tilt * z, 50))), 12)) * n * z for z, n in cells.items()}
        owed = 0.0
        for z in sorted(cells, reverse=True):
            shorter = [x for x in cells if x < z]
            below, most = sum(want[x] for x in sorted(shorter)), 3 * sum(x * cells[x] for x in shorter)
            due = owed + want[z]
            k = max(math.floor(due / z + 0.5), math.ceil((due - (most - below)) / z))
            k = min(max(min(k, max(math.floor((due + below) / z), 0)), 0), 3 * cells[z])
            owed = due - k * z
            ids = sorted((i for i, r in rows.items() if r.source == s and size[i] == z), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
            for place, i in enumerate(ids):
                copies[i] = k // len(ids) + (place < k % len(ids))
    return Counter({i: n for i, n in copies.items() if n})


def test_every_stage_and_run(spark):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in p.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mixing", "bpe encoding"]
    good = quality(rows)
    single = exact(good)
    few = near(single)
    taken = mix(few)
    assert 0 < len(few) <= len(single) <= len(good) < len(rows)
    first = p.quality(spark, docs, FOLDER)
    assert first.columns == docs.columns and sorted(r.doc_id for r in first.collect()) == sorted(good)
    second = p.exact(spark, first, FOLDER)  # stages also work on each other's rows, not only on tables
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted(single)
    third = p.near(spark, second, FOLDER)
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted(few)
    fourth = p.mix(spark, third, FOLDER)
    assert fourth.columns == docs.columns and Counter(r.doc_id for r in fourth.collect()) == taken
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for i, n in taken.items():
        ids = library.encode(rows[i].text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want += [(i, len(ids), digest, decoded)] * n
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, an empty table: no crash, and no row too many."""
    import corpus_pipeline as p

    text = " ".join(f"word{i}" for i in range(70))
    rows = [(None, text, "en", None, 5), (None, text, "en", None, 5), (1, text + " more", None, "s", None), (1, None, "en", "s", 0), (2, "", "en", "", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = p.run(spark, f"{tmp_path}/{name}").collect()
        assert len(out) <= 3 * len({r[1] for r in some if r[1]})
