"""Conversation repair, packing and the dataset manifest against brute force, and on awkward rows."""
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from helioscape.llm import conversations, manifest, packing
from helioscape.llm.queries import END_ID, ORACLES, PACKING_MODEL, QUERIES

PATTERN = __import__("re").compile(r"(s?(ua)+)?")
INSERTS = ("", "u", "ua", "a", "au")


def every_repair(symbols: str):
    """All (cost, audit) that end in a well-formed conversation, with up to two inserts at a place."""
    options = []
    for x in symbols:
        found = [(3, "D", "")]
        if x != "x":
            extra = int(x.isupper())
            found += [(extra, "K", x.lower())] + [(2 + extra, "R", r) for r in "ua"]
        options.append(found)
    places = [[(2 * len(i), "I" * len(i), i) for i in INSERTS]] * (len(symbols) + 1)
    steps = [p for pair in itertools.zip_longest(places, options, fillvalue=[(0, "", "")]) for p in pair]
    for path in itertools.product(*steps):
        if PATTERN.fullmatch("".join(p[2] for p in path)):
            yield sum(p[0] for p in path), "".join(p[1] for p in path)


@pytest.mark.parametrize("size", range(4))
def test_least_edits_against_every_repair(size):
    draw = random.Random(size)
    for symbols in {"".join(draw.choice("suaoSUAOx") for _ in range(size)) for _ in range(14)}:
        assert conversations.best_edits(symbols) == min(every_repair(symbols)), symbols


def test_chained_segments_equal_the_whole():
    draw = random.Random(3)
    for _ in range(150):
        symbols = "".join(draw.choice("ssuuuaaaoSUAOx") for _ in range(draw.randrange(1, 25)))
        cuts = sorted(draw.randrange(len(symbols) + 1) for _ in range(3))
        parts = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
        path = conversations.chain([(len(p), conversations.ways(p)) for p in parts])
        assert (sum(c for _, _, c in path), "".join(a for _, a, _ in path)) == conversations.best_edits(symbols)


def conversation_rows():
    long_talk = [(7, i, "user" if i % 2 else "assistant", f"turn {i % 40}" + ".!x"[i % 3]) for i in range(300)]
    return long_talk + [
        (1, None, None, None), (1, 0, "system", "Be kind."), (1, 0, "system", "Be kind."), (1, 4, "user", "what"), (1, 5, "user", "x" * 70000),
        (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho! \t"), (2, 1, "", "odd role."), (3, 1, "user", " \n\x0b"), (3, None, "assistant", "ok."),
        *[(20 + c, t, r, "Same text.") for c in range(30) for t, r in enumerate(("user", "assistant", "user"))]]


@pytest.mark.parametrize("segment_rows", [3, 50, conversations.SEGMENT_ROWS])
def test_repair_of_awkward_conversations(spark, segment_rows):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumns({c: F.lit("clash") for c in ("conv", "seq", "key", "copies", "symbols", "late", "size")})
    found = conversations.repair(df, "conv_id", "turn", "role", "text", segment_rows=segment_rows)
    reports = {r["conv"]: r for r in found.reports.collect()}
    digests = {r["conv"]: r["digest"] for r in found.digests().collect()}
    assert len(reports) == found.reports.count() == len(digests) == len({r[0] for r in rows})
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1] is not None, r[1] or 0, r[2] or " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv)
        mine.sort(key=lambda r: (r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, symbols, count = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in mine:
            bare = text.strip(conversations.WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            symbols += conversations.symbol(role, fault in ("blank", "duplicate"), fault == "truncated")
        cost, audit = conversations.best_edits.__wrapped__(symbols)
        roles, texts = conversations.apply_edits(audit, [r[2] for r in mine], [r[3] for r in mine])
        assert PATTERN.fullmatch("".join(r[0] for r in roles))
        turns = [r[1] for r in mine if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        got = reports[conv]
        assert (got["cost"], got["audit"], got["gaps"], got["illegal"]) == (cost, audit, gaps, illegal), conv
        assert {c: got[c] for c in count} == count
        assert digests[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()).hexdigest()
    assert found.turns().where("conv = 7").count() == len(reports[7]["audit"].replace("D", ""))


def test_damaged_conversations_without_rows_are_reported(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "All of it."), (gone + 1, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r.asDict() for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert found[gone] | {"conv_id": 0} == {"conv_id": 0, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
                                           "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert set(found) == {gone, gone + 1}


def check_pieces(rows, texts, capacity):
    """Every id once, sequences gapless and within capacity; padding as a share of the tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PACKING_MODEL)
    by_text, by_sequence = {}, {}
    for r in rows:
        by_text.setdefault(r["id"], []).append(r)
        by_sequence.setdefault(r["sequence"], []).append(r)
    for key, text in texts:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID]
        mine = sorted(by_text[key], key=lambda r: r["start"])
        assert [i for r in mine for i in np.frombuffer(r["tokens"], "<u4").tolist()] == want
        assert all(r["text_tokens"] == len(want) and r["length"] == len(r["tokens"]) // 4 > 0 for r in mine)
        assert [r["start"] for r in mine] == [0, *itertools.accumulate(r["length"] for r in mine)][:-1]
    padding = 0
    for mine in by_sequence.values():
        mine.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == [0, *itertools.accumulate(r["length"] for r in mine)][:-1]
        total = sum(r["length"] for r in mine)
        assert total <= capacity
        padding += 0 if total & (total - 1) == 0 else capacity - total
    return padding


def test_packing_of_awkward_texts(spark):
    draw = random.Random(5)
    texts = [None, "", " \n ", "<|endoftext|> <|ENDOFTEXT|>", "it's 'so. Straße ÀÉ! É́ ΟΔΟΣ 漢字😀", "a" * 30000, "$$$%%%, x.'s", "İI ǅ"]
    texts += [" ".join(draw.choice(("Word,", "éa.", "12", "the", "q!?")) for _ in range(draw.randrange(1, 3000))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("id", "start", "tokens", "sequence", "offset")})
    for capacity, block in ((2048, packing.BLOCK_TOKENS), (64, 1000)):
        found = packing.pack_texts(df, "doc_id", "text", PACKING_MODEL, END_ID, capacity, block).collect()
        assert check_pieces(found, rows, capacity) == 0
    twice = packing.pack_texts(df.where("doc_id = 9").union(df.where("doc_id = 9")), "doc_id", "text", PACKING_MODEL).agg(F.sum("length")).head()[0]
    assert twice == 2 * df.sparkSession.createDataFrame([rows[9]], "doc_id long, text string").transform(
        lambda d: packing.pack_texts(d, "doc_id", "text", PACKING_MODEL)).agg(F.sum("length")).head()[0]
    assert packing.pack_texts(df.where("false"), "doc_id", "text", PACKING_MODEL).count() == 0


def best_fit(lengths, capacity):
    """Costs of sequences when every text, by falling length, goes to the fullest sequence that has room for it."""
    room, spent = [], []
    for left in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= left]
        if not fits:
            room.append(capacity)
            spent.append(0)
            fits = [len(room) - 1]
        chosen = min(fits, key=room.__getitem__)
        room[chosen] -= left
        spent[chosen] += packing.cost(left)
    return spent


def test_packing_balances_cost():
    draw = random.Random(8)
    lengths = [draw.randrange(10, 700) for _ in range(900)]
    spent = {}
    for _, _, size, sequence, _ in packing.pack(lengths):
        spent[sequence] = spent.get(sequence, 0) + packing.cost(size)
    full = [spent[i] for i, size in enumerate(packing.sizes_for(sum(lengths))) if size == packing.CAPACITY]
    assert np.std(full) < 0.7 * np.std(best_fit(lengths, packing.CAPACITY)[:len(full)])


def naive_tree(leaves):
    """Root and the siblings (left, right) of every leaf, level by level."""
    paths, level, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        runs = [range(i, min(i + 8, len(level))) for i in range(0, len(level), 8)]
        for run in runs:
            for j in run:
                step = ("".join(level[k] for k in run if k < j), "".join(level[k] for k in run if k > j))
                for i in under[j]:
                    paths[i].append(step)
        under = [[i for j in run for i in under[j]] for run in runs]
        level = [manifest.digest("".join(level[j] for j in run)) for run in runs]
    return level[0], paths


@pytest.mark.parametrize("leaves,levels", [(1, 1), (2, 1), (8, 2), (9, 2), (70, 3), (512, 3), (513, 4), (600, 4)])
def test_positions_in_the_log(leaves, levels):
    names = [f"{i}" for i in range(leaves)]
    log = manifest.append_log(names, levels)
    level = names
    for h in range(levels + 1):
        for j, node in enumerate(level):
            assert log[manifest.position(h, j, leaves, levels)] == node
        level = [manifest.digest("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
    assert manifest.segment_paths(log, leaves, manifest.height(leaves)) == naive_tree(names)[1] or manifest.height(leaves) != levels


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_of_awkward_rows(spark, levels):
    rows = [(i, "l1" if i % 3 else "l2", f"text {i}") for i in range(700)] + [(5, "l1", "text 5"), (5, "l1", "other"), (None, "l1", None), (9, None, ""), (10, "", "é漢")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(7)
    df = df.withColumns({c: F.lit("clash") for c in ("id", "tree", "leaf", "place", "leaves", "log", "path")})
    value = manifest.leaf([F.col("doc_id"), F.col("lang"), F.col("text")])
    claim = manifest.leaf([F.col("doc_id"), F.col("lang"), F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text"))])
    found = manifest.build_manifest(df, "doc_id", "lang", value, claim, levels=levels)
    got = sorted((r["tree"] or "-", r["id"] if r["id"] is not None else -1, r["leaf"], r["subroot"], r["root"], r["siblings"], r["folded"] == r["root"])
                 for r in found.proofs().collect())
    plain = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for i, lang, text in rows:
        trees.setdefault(lang, []).append((i is not None, i or 0, manifest.digest("".join(map(plain, (i, lang, text)))), i, text))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    done = {t: naive_tree([r[2] for r in sorted(trees[t], key=lambda r: r[:3])]) for t in order}
    root, top = naive_tree([done[t][0] for t in order])
    want = []
    for t, over in zip(order, top):
        for r, path in zip(sorted(trees[t], key=lambda r: r[:3]), done[t][1]):
            same = r[3] is None or r[3] % 5 or (r[4] or "").upper() == (r[4] or "")
            want.append((t or "-", -1 if r[3] is None else r[3], r[2], done[t][0], root, "".join(a + b for a, b in path + over), bool(same)))
    assert got == sorted(want)
    # the log holds every node once, in completion order
    for stage in found.stages:
        for r in stage.where("tree = 'l1'").collect():
            assert r["start"] == manifest.before(r["segment"] * 8**levels, manifest.height(r["leaves"]))


def test_manifest_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert manifest.build_manifest(df, "doc_id", "lang", manifest.leaf([F.col("text")])).proofs().count() == 0


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_merkle_manifest"])
def test_nulls_in_every_column_against_sql(spark, tmp_path, name):
    import duckdb

    if name.startswith("op11"):
        rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, 1, 2, 3) for r, x in ((None, "a."), ("user", None)) for _ in range(1 + (t == 2))]
        file, df = "conversations", spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    else:
        rows = [(i, s, g, n, x) for i, (s, g, n, x) in enumerate(itertools.product((None, "s"), (None, "g", ""), (None, 3), (None, "", "ABc é")))] * 2
        file, df = "documents", spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.write.parquet(f"{tmp_path}/{file}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {file} as select * from read_parquet('{tmp_path}/{file}.parquet/*.parquet')")
    assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None
