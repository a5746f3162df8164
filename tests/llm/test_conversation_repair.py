import hashlib
import random
import zlib
from collections import defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm import conversation_repair as R

ROWS = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def plain_edits(initials, faults):
    """Cost and audit by the shortest path over all places and states, strings compared whole."""
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {(0, ""): (0, "")}
    for place in range(len(initials) + 1):
        for _ in range(4):  # inserts at this place
            for state in list(grammar):
                if (place, state) in best:
                    cost, audit = best[place, state]
                    to = "a" if state == "u" else "u"
                    new = (cost + 2, audit + "I")
                    if (place, to) not in best or new < best[place, to]:
                        best[place, to] = new
        if place == len(initials):
            break
        for state in grammar:
            if (place, state) not in best:
                continue
            cost, audit = best[place, state]
            moves = [(state, 3, "D")]
            if faults[place] in ("", "truncated"):
                more = int(faults[place] == "truncated")
                if initials[place] in grammar[state]:
                    moves.append((initials[place], more, "K"))
                moves.append(("a" if state == "u" else "u", 2 + more, "R"))
            for to, price, edit in moves:
                new = (cost + price, audit + edit)
                if (place + 1, to) not in best or new < best[place + 1, to]:
                    best[place + 1, to] = new
    return min(best[len(initials), state] for state in ("", "a") if (len(initials), state) in best)


FAULTS = st.sampled_from(["", "", "", "truncated", "blank", "duplicate"])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.sampled_from("suax"), FAULTS), max_size=14), st.sampled_from([1, 2, 3, 32]))
def test_search_finds_the_first_of_the_cheapest(rows, block):
    initials, faults = "".join(r for r, _ in rows), [f for _, f in rows]
    codes = R.row_codes(initials, faults)
    cost, audit = R.Search(codes, block).run()
    assert cost == plain_edits(initials, faults)[0]
    # Of all edits of that cost none comes first: every shorter prefix order is tried.
    assert audit == first_of_cost(initials, faults, cost)


def first_of_cost(initials, faults, cost):
    """The ASCII-least accepting audit of a cost, by trying letters in order."""
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    dead = set()

    def go(place, state, left):
        if left < 0 or (place, state, left) in dead:
            return None
        if place == len(initials) and state in ("", "a") and left == 0:
            return ""
        wanted = "a" if state == "u" else "u"
        moves = []
        if place < len(initials):
            moves.append(("D", place + 1, state, 3))
        moves.append(("I", place, wanted, 2))
        if place < len(initials) and faults[place] in ("", "truncated"):
            more = int(faults[place] == "truncated")
            if initials[place] in grammar[state]:
                moves.append(("K", place + 1, initials[place], more))
            moves.append(("R", place + 1, wanted, 2 + more))
        for edit, p, s, price in moves:
            found = go(p, s, left - price)
            if found is not None:
                return edit + found
        dead.add((place, state, left))
        return None

    return go(0, "", cost)


def test_short_ones_by_hand():
    def run(initials, *faults):
        return R.cheapest_edits(R.row_codes(initials, list(faults) or [""] * len(initials)))

    assert run("") == (0, "")
    assert run("sua") == (0, "KKK")
    assert run("ua") == (0, "KK")
    assert run("s") == (3, "D")
    assert run("u") == (2, "KI")
    assert run("uu") == (2, "KR")
    assert run("a") == (2, "IK")
    assert run("uua") == (2, "KIKK")
    assert run("su", "", "truncated") == (3, "KKI")


def test_long_conversations_take_time_in_proportion():
    rng = random.Random(5)
    visits = []
    for n in (2_000, 8_000):
        initials = "s" + "".join(rng.choice("uuaaax") for _ in range(n))
        faults = [rng.choice(["", "", "", "truncated", "blank"]) for _ in initials]
        search = R.Search(R.row_codes(initials, faults))
        cost, audit = search.run()
        assert cost == plain_edits(initials, faults)[0] if n < 4_000 else cost > 0
        assert len(audit.replace("I", "")) == len(initials)
        visits.append(search.visited)
    assert visits[1] < 6 * visits[0]


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_report(rows):
    out = []
    for conv, own in damage(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(BLANK)
            if not bare:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in own]
        turns = {t for t, *_ in own if t is not None}
        cost, _ = plain_edits(initials, faults)
        audit = first_of_cost(initials, faults, cost)
        left, k, state = [], 0, ""
        for edit in audit:
            wanted = {"u": "user", "a": "assistant"}["a" if state == "u" else "u"]
            if edit == "I":
                left.append(f"{wanted}:")
                state = wanted[0]
                continue
            _, role, text = own[k]
            k += 1
            if edit != "D":
                role = role if edit == "K" else wanted
                left.append(f"{role}:{text}")
                state = role[0]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append(
            (
                conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                hashlib.sha256("\n".join(left).encode()).hexdigest(),
            )
        )
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def made_rows(seed, conversations):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            text = rng.choice(["Yes.", "No", " ", "Long one! ", "What?\n", "…", f"Number {turn}.", "a\x0b"])
            rows.append((conv, turn * rng.choice([1, 1, 2]) + (turn > 5), role, text))
    unique = {(c, t): (c, t, r, x) for c, t, r, x in rows}
    return list(unique.values())


def test_report_agrees_with_the_plain_version(spark):
    rows = made_rows(1, 120)
    rows += [(None, 1, "user", "Hi."), (None, 3, "assistant", "Hello."), (500, None, "system", "Be kind."), (500, 0, "user", None)]
    rows += [(501, k, None, "x.") for k in range(3)]
    dropped = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    table = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as row", "2 as code", "'z' as content", "3 as n")
    got = R.repair_report(R.damaged(table), table).collect()
    want = plain_report(rows)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[6] > 0 for r in want) > 50


def test_a_conversation_of_most_rows_is_split(spark):
    rng = random.Random(7)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 300)}{rng.choice('.! ')}") for k in range(600)]
    rows += made_rows(3, 20)
    rows = list({(c + 10 if c < 1 else c, t): (c + 10 if c < 1 else c, t, r, x) for c, t, r, x in rows}.values())
    got = R.repair_report(R.damaged(spark.createDataFrame(rows, ROWS)), spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_report(rows), key=key)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U."), (1, 2, "user", "U."), (2, 0, "user", " ")]
    got = [tuple(r) for r in R.repair(spark.createDataFrame(rows, ROWS)).orderBy("conv_id", "place").collect()]
    # The repeat and the blank row go; of the cheapest ways inserting comes before keeping.
    assert got == [
        (1, 0, "K", 0, "system", "S."), (1, 1, "I", None, "user", ""), (1, 2, "K", 1, "assistant", "A."),
        (1, 3, "K", 2, "user", "U."), (1, 4, "I", None, "assistant", ""),
    ]
    assert R.cheapest_edits(R.row_codes("sauu", ["", "", "", "duplicate"])) == (7, "KIKKDI")


def test_rows_of_one_turn_and_repeats_stand_together(spark):
    rows = [(1, 0, "user", "b."), (1, 0, "assistant", "c."), (1, 0, "user", "b."), (1, 0, "user", "b.")]
    found = R.audits(spark.createDataFrame(rows, ROWS)).first()
    assert (found["duplicate"], found["gaps"], found["illegal"]) == (2, 0, 2)


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert R.repair_report(R.damaged(empty), empty).collect() == []
    assert R.repair(empty).collect() == []


@pytest.mark.parametrize("codes", ["".join(p) for p in product("suax", repeat=3)])
def test_all_short_role_sequences(codes):
    cost, audit = R.cheapest_edits(R.row_codes(codes, [""] * 3))
    assert cost == plain_edits(codes, [""] * 3)[0] and audit == first_of_cost(codes, [""] * 3, cost)
