"""URL rules, sharding, byte-level BPE and benchmark decontamination."""

from __future__ import annotations

import base64
import hashlib
import random
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken

import brute
from marketmood.llm import bpe, decontaminate, shards, url_rules
from marketmood.llm.queries import tokenizer

URLS = [
    "http://www.Example.com/en/x?y", "https://a.b.example.com/en", "https://example.com/en/", "ftp://net/fr/1", "http://x.net/es/?q",
    "http://com", "http://xcom/", "http://com/", "http://notexample.com/en/", "http://www.example.com#en/", "no scheme", "", None,
    "a://b://c.com/", "http:///en/", "http://.com/", "http://ÄB.com/Ä", "http://example.com:80/en/", "http://deep." + "s." * 50 + "example.com/en/" + "z" * 5000,
]


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_url_verdicts(spark, ranges):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[0], "", "")] + [(500 + i % 40, "http://hot.example.com/en/%d" % i, "", "") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    found = url_rules.judge_pages(pages, url_rules.rule_table(spark), ranges=ranges).collect()
    want = [(p, *brute.url_verdict(u, url_rules.RULES)) for p, u, _, _ in rows]
    assert sorted((tuple(r) for r in found), key=str) == sorted(want, key=str)


def test_many_nested_url_rules(spark):
    draw = random.Random(6)
    hosts = [".".join(draw.choice("abc") for _ in range(draw.randrange(1, 4))) for _ in range(60)]
    rules = {(draw.choice(hosts), "/" + draw.choice(["", "x", "x/y", "z"])): draw.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    rows = [(i, "http://%s/%s" % (draw.choice(hosts), draw.choice(["x", "x/y/z", "", "zz"]))) for i in range(300)]
    found = url_rules.judge_pages(spark.createDataFrame(rows, "page_id long, url string"), url_rules.rule_table(spark, rules), ranges=9).collect()
    assert sorted(tuple(r) for r in found) == sorted((p, *brute.url_verdict(u, rules)) for p, u in rows)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert {r["verdict"] for r in url_rules.judge_pages(pages, none).collect()} == {"allow"}
    assert url_rules.judge_pages(pages.limit(0), none).count() == 0


def test_shards_are_contiguous_balanced_and_gapless(spark, make_docs):
    draw = random.Random(7)
    rows = [(i, "t%d " % i * draw.randrange(1, 60)) for i in range(400)] + [(1000 + i, "hot " * 30) for i in range(300)]
    rows += [(3, "t3"), (3, "t3"), (None, "null id"), (5000, None), (5001, ""), (5002, "é" * 50)]
    found = shards.assign_shards(make_docs(rows)).collect()
    sizes = {}
    for r in found:
        sizes.setdefault(r["shard"], []).append(r)
    total = sum(r["size"] for r in found)
    assert total == sum(len((t or "").encode()) + 1 for _, t in rows) and set(sizes) == set(range(8))
    for own in sizes.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= total / 8 * 2 * shards.TOLERANCE + max(r["size"] for r in found)
    crcs = sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found if r["doc_id"] is not None)
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None), key=str)
    assert sorted(crcs, key=str) == want
    where = {}
    for r in found:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert [c for c, s in where.items() if len(s) > 1] == [zlib.crc32(("hot " * 30).encode())]


def test_shards_of_few_rows(make_docs):
    assert shards.assign_shards(make_docs([])).count() == 0
    one = shards.assign_shards(make_docs([(1, "x" * 100)])).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


@pytest.fixture(scope="module")
def own():
    return tokenizer()


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_tells_others_apart(own):
    table = own.table
    assert sorted(table.values) == list(range(len(own.tokens))) and table.n == len(own.tokens)
    assert all(table.find(t) == i for i, t in enumerate(own.tokens))
    others = [b"%d no token" % i for i in range(2000)]
    assert {table.find(t) for t in others if t not in own.ranks} == {-1}
    assert bpe.PerfectHash([]).find(b"x") == -1


def test_bpe_equals_the_library(spark, make_docs, own, library, sf_dir):
    texts = ["", None, "  \n\n x", "a" * 3000, "héé🎉🎉 ß<|endoftext|>\u3000a", "'S 're don't 12345", "\x00\t\r\n", "thereblending " * 40]
    texts += [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").orderBy("doc_id").collect()]
    docs = make_docs(list(enumerate(texts)) + [(None, "x")])
    found = bpe.encode_texts(docs, own).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        text = ("x" if r["doc_id"] is None else texts[r["doc_id"]]) or ""
        ids = library.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == text
        assert r["ids_sha256"] == hashlib.sha256(struct.pack("<%dI" % len(ids), *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_items_inside_documents(make_docs, spark, monkeypatch):
    draw = random.Random(8)
    word = lambda: "k%d" % draw.randrange(300)
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 2, 4, 5, 6, 8, 20, 40])))) for i in range(40)]
    items += [(40, None), (41, " "), (3, items[3][1]), (42, items[3][1]), (None, "only null id item here now")]
    docs = []
    for i in range(60):
        own = [word() for _ in range(draw.choice([0, 3, 50, 900]))]
        for item in draw.sample(items[:40], 2):
            copy = item[1].split()
            for _ in range(draw.randrange(3)):
                copy[draw.randrange(len(copy))] = draw.choice([word(), "K1"])
            at = draw.randrange(len(own) + 1)
            own[at:at] = copy
        docs.append((i, " ".join(own).replace("k1", "K1")))
    docs += [(70, None), (71, ""), (None, items[5][1]), (5, items[6][1]), (5, items[6][1]), (72, "only null id ITEM here now")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute.held_items(docs, items)
    for bits in (decontaminate.MOST_BITS, 12):
        monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
        found = decontaminate.find_items(make_docs(docs), table).collect()
        assert sorted((tuple(r)[:4] for r in found), key=str) == want
    held = {d for d, *_ in want}
    clean = decontaminate.clean(make_docs(docs), table).collect()
    assert sorted((r["doc_id"] for r in clean), key=str) == sorted((d for d, _ in docs if d not in held), key=str)
    assert decontaminate.find_items(make_docs(docs), table.limit(0)).count() == 0
    assert decontaminate.find_items(make_docs([]), table).count() == 0
