"""Periodic runs, chat formatting and conversation repair against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stocklens.llm import runs as runs_op
from stocklens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


# --- periodic runs ------------------------------------------------------------------------

def naive_lyndon(s):
    """Distance to the next smaller suffix."""
    n = len(s)
    return [next((j - i for j in range(i + 1, n) if s[j:] < s[i:]), n - i) for i in range(n)]


def naive_runs(s, least=6, exponent=4):
    out, n = [], len(s)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i:
                size = j - i + q
                if size >= max(least, exponent * q) and not any(
                        q % d == 0 and all(s[x] == s[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        letters = rng.randint(1, 4)
        s = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6 and s:
            root = s[:rng.randint(1, min(6, len(s)))]
            s = s[:rng.randint(0, 8)] + root * rng.randint(2, 7) + root[:rng.randint(0, len(root))] + s[-rng.randint(1, 8):]
        yield s


def test_grouping_gives_the_lyndon_arrays_of_both_orders():
    for s in sequences(1, 1500):
        for t in (s, [-v for v in s]):
            length, group = runs_op.lyndon_groups(t)
            assert length == naive_lyndon(t)
            words = [tuple(t[i:i + m]) for i, m in enumerate(length)]
            assert len(set(group)) == len(set(words)) == len(set(zip(group, words, strict=True)))


def test_runs_equal_brute_force_with_and_without_cuts():
    for s in sequences(2, 3000):
        assert runs_op.runs_of(s) == naive_runs(s)
        _, (found,), _ = runs_op.runs_of_texts([" ".join(map(str, s))], 6, 4)
        assert found == naive_runs(s)
        _, (found,), _ = runs_op.runs_of_texts([" ".join(map(str, s))], 3, 3)
        assert found == naive_runs(s, 3, 3)


def test_runs_of_long_repetitive_sequences_take_linear_time():
    fib = [0], [0, 1]
    while len(fib[1]) < 20_000:
        fib = fib[1], fib[1] + fib[0]
    assert runs_op.runs_of(fib[1]) == []
    assert runs_op.runs_of([7] * 50_000) == [(0, 50_000, 1)]
    assert runs_op.runs_of(list(range(1000)) * 40 + [1]) == [(0, 40_000, 1000)]


def edited(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected_runs_row(doc_id, text):
    words = edited(doc_id, text)
    found = naive_runs(words)
    best = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    gone = {i for b, m, q in found for i in range(b + q, b + m)}
    return (doc_id, len(found), *(best[:2] if best else (None, None)), best and best[2], best and 1000 * best[1] // best[2],
            sha("".join(f"{b},{m},{q}\n" for b, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    """Whole small documents of the driver's table, ids under which periods are planted, odd rows."""
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 2500]
    rows += [(10_000 + i, " ".join(rng.choice("ab cd ef gh é 你".split()) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, None), (None, "a a a a a a"), (20_001, ""), (20_002, " \t\n\x0b\x0c\r "), (20_003, "x " * 6), (20_003, "x " * 6),
             (20_004, "a b a b c"), (20_005, "é\x1cy " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn(
        "n_words", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected_runs_row(*r) for r in rows]
    assert sum(w[1] for w in want) > 60
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_find_runs_interface(spark):
    df = spark.createDataFrame([(1, "go a b a b a b a b stop"), (2, None)], "doc_id long, text string")
    a, b = runs_op.find_runs(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in a.runs] == [(1, 8, 2)] and a.collapsed == "go a b stop" and a.n_words == 10
    assert (b.n_words, b.runs, b.collapsed) == (0, [], "")
    assert runs_op.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs_op.find_runs(df, exponent=2)


# --- chat formatting ----------------------------------------------------------------------

def by_conversation(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, chat_escape(role or ""), chat_escape(text or ""), role or "", text or ""))
    return {c: [(r[4], r[5]) for r in sorted(rs, key=lambda r: r[:4])] for c, rs in convs.items()}


def chat_escape(t):
    return t.replace("\\", "\\\\").replace("<|", "<\\|")


def plain_windows(turns, budget, history, history_budget):
    """Greedy windows, one turn after the other: (first own, first repeated, end, system?)."""
    cost = [len(re.findall(r"[^\W\d_]+|\d+|[^\w\s]|_", t)) + 4 for _, t in turns]
    head = bool(turns) and turns[0][0] == "system"
    out, k = [], 0
    while k < len(turns):
        segment_end = min(len(turns), (k // 256 + 1) * 256)
        system = cost[0] if head and k else 0
        c = k
        while c - 1 >= max(k - history, int(head)) and sum(cost[c - 1:k]) <= history_budget:
            c -= 1
        if system + sum(cost[c:k + 1]) > budget:
            c = k
        end = k + 1
        while end < segment_end and system + sum(cost[c:end + 1]) <= budget:
            end += 1
        out.append((k, c, end, bool(head and k)))
        k = end
    return out


def chat_rows(seed):
    rng = random.Random(seed)
    pieces = ["hello", "two words", "<|end|>\n", "<|", "\\", "<\\|turn|>", "<", "|>", "é 你好", "", "\n", "x" * 50, "12 3"]
    rows = []
    for conv in [*range(40), None]:
        n = 700 if conv == 3 else rng.randint(1, 9)
        for t in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool\\", "<|text|>", None]) if t else rng.choice(["system", "user"])
            rows.append((conv, rng.choice([t, t, t, None]), role, rng.choice([None, *[" ".join(rng.choices(pieces, k=rng.randint(0, 12)))] * 9])))
    return rows + rows[-3:] + [(77, 5, "user", "word " * 30_000), (77, 6, "assistant", "reply")]


def test_chat_windows_equal_greedy_windows_and_mask_each_answer_once(spark):
    rows = chat_rows(5)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("first_turn", F.lit("clash"))
    from stocklens.llm import chat
    got = {}
    for w in chat.read_turns(chat.chat_windows(df, budget=60, history=2, history_budget=20)).collect():
        got.setdefault(w.conv_id, []).append(w)
    want = by_conversation(rows)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        ws = sorted(got[conv], key=lambda w: w.first_turn)
        plain = plain_windows(turns, 60, 2, 20)
        assert [(w.first_turn, w.n_turns, w.n_repeated) for w in ws] == [(k, e - k, k - c + s) for k, c, e, s in plain]
        for w, (k, c, e, s) in zip(ws, plain, strict=True):
            shown = turns[:int(s)] + turns[c:e]
            assert w.text == "".join(f"<|turn|>{chat_escape(r)}<|text|>{chat_escape(t)}<|end|>\n" for r, t in shown)
            assert [(t.role, t.text) for t in w.turns] == turns[k:e]
            assert w.learnt == [t for r, t in turns[k:e] if r == "assistant"]
            assert w.n_tokens <= 60 or e - k == 1
    assert sum(len(v) for v in got.values()) > 200
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_chat_query_reads_back_every_conversation(spark, tmp_path):
    rows = chat_rows(6) + [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
                           if r.conv_id > 40]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(["user", "assistant"])]
    df = QUERIES["op11_chat_format"](spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    got = {r.conv_id: r for r in df.collect()}
    want = by_conversation(rows)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (
            len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt))
        assert g.formatted_chars >= sum(len(chat_escape(r)) + len(chat_escape(t)) + 24 for r, t in turns)


# --- conversation repair ------------------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?")


def least_edits(kinds):
    """(cost, audit, made roles) by a suffix table over rows and grammar states, one row at a time."""
    from stocklens.llm import repair
    best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for kind in reversed(kinds):
        now = {}
        for s in range(4):
            options = [(4 + best[s][0], "D" + best[s][1])]
            if kind != 8:
                extra = 3 * (kind % 2)
                after = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}[kind // 2].get(s)
                if after is not None:
                    options.append((extra + best[after][0], "K" + best[after][1]))
                after = best[repair.NEXT[s]]
                options.append((3 + extra + after[0], "R" + after[1]))
            now[s] = min(options)
        for _ in range(4):
            for s in range(4):
                cost, audit = now[repair.NEXT[s]]
                now[s] = min(now[s], (3 + cost, "I" + audit))
        best = now
    return best[0]


def all_edits(rows):
    """Least (cost, audit) by trying every list of edits: rows are (initial, forced, truncated)."""
    best = (4 * len(rows) + 1, "")

    def go(i, initials, cost, audit):
        nonlocal best
        if cost > best[0] or len(audit) > 2 * len(rows) + 2:
            return
        if i == len(rows) and GRAMMAR.fullmatch(initials) and (cost, audit) < best:
            best = (cost, audit)
        go_on = [("I", i, x, 3) for x in "ua"]
        if i < len(rows):
            initial, forced, truncated = rows[i]
            go_on.append(("D", i + 1, "", 4))
            if not forced:
                go_on += [("K", i + 1, initial, 3 * truncated), *(("R", i + 1, x, 3 + 3 * truncated) for x in "ua")]
        for edit, j, made, more in go_on:
            go(j, initials + made, cost + more, audit + edit)

    go(0, "", 0, "")
    return best


def test_block_tables_give_the_least_edits():
    from stocklens.llm import repair
    rng = random.Random(8)
    t = repair.tables()
    assert len(t.vectors) < 200
    for n in [*range(5)] * 60:
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        kinds = [8 if f else 2 * "suax".index(i) + z for i, f, z in rows]
        assert all_edits(rows) == least_edits(kinds)
    for n in [*range(30)] * 20:
        kinds = [rng.choice([0, 1, 2, 2, 2, 3, 4, 4, 4, 5, 6, 7, 8]) for _ in range(n)]
        edits, state = t.walk(repair.kinds_of("".join(map(str, kinds))), 0, 0, True)
        cost, audit = least_edits(kinds)
        assert "".join(e[0] for e in edits) == audit and state in (0, 3)
        assert cost == t.vectors[t.read(repair.kinds_of("".join(map(str, kinds))), 0)[0][0]][0] + t.read(
            repair.kinds_of("".join(map(str, kinds))), 0)[1]


def spaced(x):
    return " " if x is None else str(x)


def expected_repair(rows):
    """Rows of op13 from (conv, turn, role, text), without blocks or segments."""
    convs, out = {}, []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        role, text = ("user" if h == 4 else role), ("" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        convs.setdefault(conv, []).extend([(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(h, 1))
    for conv, rs in convs.items():
        rs.sort()
        faults, seen = [], set()
        for _, _, role, text in rs:
            body = text.strip("\t\n\x0b\x0c\r ")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        kinds = [8 if f in ("blank", "duplicate") else 2 * {"s": 0, "u": 1, "a": 2}.get(r[2][:1], 3) + (f == "truncated")
                 for r, f in zip(rs, faults, strict=True)]
        cost, audit = least_edits(kinds)
        lines, state, at = [], 0, 0
        for e in audit:
            if e in "IR":
                made = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
            elif e == "K":
                made = rs[at][2]
            if e != "D":
                lines.append(f"{made}:{'' if e == 'I' else rs[at][3]}")
                state = {"s": 1, "u": 2, "a": 3}[made[0]]
            at += e != "I"
        assert at == len(rs) and GRAMMAR.fullmatch("".join(x[0] for x in lines))
        turns = [r[1] for r in rs if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines))))
    return out


def test_repair_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = ["Hello.", "Why?", "no stop", "Hello.", " ok! \n", "", " \t", None, "x" * 20 + ".", "é."]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for conv in [*range(1000, 1300), None]:
        for t in range(rng.randint(1, 10)):
            rows.append((conv, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
                         rng.choice([f"{t} said.", f"{t} cut", *texts])))
    for t in range(2500):
        rows.append((5000, rng.choice([t, t, 7, None]), ["user", "assistant"][t % 2] if rng.random() < 0.8 else "system", rng.choice([f"{t}.", f"{t}", "again."])))
    rows += [(5001, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(1024)]
    rows += [(6000, None, None, None), (6001, 3, "user", "long " * 40_000)] + rows[:3]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit("clash")).withColumn(
        "segment", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_repair_turns"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = expected_repair(rows)
    assert {c for w in want for c in w[7]} == set("DIKR")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_sequence_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op12_periodic_runs"](spark, str(tmp_path)).count() == 0
    assert QUERIES["op13_repair_turns"](spark, str(tmp_path)).count() == 0
    assert [r.conv_id for r in QUERIES["op11_chat_format"](spark, str(tmp_path)).collect()] == [-7]
