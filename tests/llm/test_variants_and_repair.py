"""Spelling variants and conversation repair against brute force, with nulls, ties, repeated rows, long rows and empty tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from adloom.llm import conversations, spelling

LETTERS = "A-Za-zÀ-ÿ"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_variants(docs):
    count = Counter()
    for i, text in docs:
        for w in re.findall(f"[{LETTERS}]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += len(w) >= 7
    n = {w: k for w, k in count.items() if k >= 2}
    near, cuts = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1:]
            cuts[i, cut].add(w)
            if cut in n:
                near[w].add(cut), near[cut].add(w)
    for group in cuts.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w
    return {(w, k, len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w, k in n.items()}


def found_variants(df, **more):
    return {tuple(r) for r in spelling.variants(df, **more).select("word", "n", "n_near", "form", "form_n", "root").collect()}


@pytest.mark.parametrize("tile", [2048, 3])
def test_variants(spark, tile):
    random.seed(11)
    base = ["consider", "considér", "straßen", "ÀÉÎÕÜýÿ", "aaaaaaa", "abcdefgh" * 60]
    docs = []
    for i in range(150):
        w = [random.choice(base) for _ in range(60)]
        for k in range(len(w)):
            for _ in range(random.choice([0, 0, 0, 0, 1, 1, 2])):
                at = random.randrange(len(w[k]))
                w[k] = w[k][:at] + random.choice(["", "a", "é", "x"]) + w[k][at + random.randint(0, 1):]
        docs.append((i % 140 if i else None, random.choice([" ", "-", "1"]).join(w)))
    docs += [(200, None), (201, ""), (202, "considerably" * 5000), (203, "considerably" * 5000)] + [docs[5]] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key", "side", "low", "block")})
    want = expected_variants(docs)
    assert sum(w[3] is not None for w in want) > 20 and any(w[5] not in (w[0], w[3]) for w in want)
    assert found_variants(df, tile=tile) == want
    assert spelling.variants(df.limit(0)).count() == 0


def test_distances(spark):
    """The tile's rule against a plain edit distance, for all pairs of short words."""
    random.seed(2)
    some = sorted({"".join(random.choice("aé") for _ in range(random.randint(7, 9))) for _ in range(120)})
    got = {r.word: r.n_near for r in spelling.near_words(spark.createDataFrame([(w, 2) for w in some], "word string, n long")).collect()}
    df = spark.createDataFrame([(a, b) for a in some for b in some if a != b], "a string, b string")
    want = {r.a: r["count"] for r in df.filter(F.levenshtein("a", "b") == 1).groupBy("a").count().collect()}
    assert got == want and len(got) > 30


def expected_repair(rows):
    """Shortest path by a queue over (cost, audit), with any number of inserted rows anywhere; rows are (turn, role, text) after the damage, in order."""
    seen, kind, counts, before = set(), [], Counter(), None
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        kind.append(fault)
        counts[fault] += 1
        if before is not None:
            counts["illegal"] += before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
    # Wanted next by what was written: nothing or system or assistant: user; user: assistant.
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, out = heapq.heappop(queue)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            break
        after = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[after]
        heapq.heappush(queue, (cost + 3, audit + "I", i, after, (*out, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, last, out))
            if kind[i] in ("", "truncated"):
                more = 3 if kind[i] else 0
                heapq.heappush(queue, (cost + 3 + more, audit + "R", i + 1, after, (*out, f"{name}:{text}")))
                if role[:1] == after or (role[:1] == "s" and last == ""):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def expected_damage(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        groups[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {(conv, *expected_repair(sorted(g, key=order))) for conv, g in groups.items()}


SCHEMA = "conv_id long, turn long, role string, text string"


def some_rows():
    random.seed(4)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Fine.", "Well!", "no end", " \n", "", None, "Fine.", "é?  ", "x" * 2000 + "."]
    rows = [(c, random.choice([t, t, t + 3, None, 5]), random.choice(roles[:2] * 4 + roles), random.choice(texts[:2] * 2 + texts)) for c in range(250) for t in range(random.randint(1, 9))]
    rows += [(None, t, "user", "Hi.") for t in range(9)] + [(400, None, None, None)] * 3
    # Long ones: regular, one whose paths stay apart for long, random.
    rows += [(500, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(900)]
    rows += [(501, t, "user", f"Turn {t}.") for t in range(700)]
    return rows + [(502, t, random.choice(["user", "assistant", "tool"]), random.choice([f"Turn {t}.", "the same."])) for t in range(800)]


def test_repair(spark):
    rows = some_rows()
    df = spark.createDataFrame(random.sample(rows, len(rows)), SCHEMA).withColumns({c: F.lit("x") for c in ("dropped", "repeated", "kind", "place", "copy")})
    got = {tuple(r) for r in conversations.damage_report(df).collect()}
    want = expected_damage(rows)
    assert len(want) == len(got) and got == want
    assert conversations.damage_report(df.limit(0)).count() == 0


def test_conversation_that_is_dropped(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.damage_report(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)).first()
    assert tuple(got) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_messages_carry_the_digest(spark):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    rows = conversations.damaged(df)
    lines = defaultdict(dict)
    edits = defaultdict(Counter)
    for r in conversations.repaired_messages(rows).collect():
        edits[r.conv_id][r.edit] += 1
        if r.place is not None:
            lines[r.conv_id][r.place] = f"{r.role}:{r.text}"
    for r in conversations.repair(rows).collect():
        text = "\n".join(lines[r.conv_id][i] for i in range(len(lines[r.conv_id])))
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256 and edits[r.conv_id] == Counter(r.audit)
    clean = conversations.repair(conversations.whole(spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello.")], SCHEMA))).first()
    assert (clean.cost, clean.audit) == (0, "KKK")


def test_open_paths_are_exact():
    """Paths that stay apart beyond the window of open rows widen the digits."""
    now = conversations.Conversation(1)
    rows = [(t, "assistant" if t % 2 else "user", "" if t % 3 else f"Turn {t}.") for t in range(400)]
    for t, role, text in rows:
        now.add(t, role, text, False)
    now.close()
    want = expected_repair([(t, r, x) for t, r, x in rows])
    assert now.summary()[5:] == want[5:]
