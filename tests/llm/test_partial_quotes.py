"""Partial, re-wrapped and repeated quotes against a plain substring search."""

import numpy as np
from evidara.llm import quotes

TURNS = [
    "The first point is cost. The second point is time! Is the third one risk? We shall see.",
    "Alpha beta gamma delta\nepsilon zeta.\n\nEta theta iota\nkappa lambda.\n\nMu nu xi omicron.",
    "Same words here.",
    "> The second point is time!\nAgreed.",
    "> Alpha beta gamma\n> delta epsilon zeta.\n>\n> Eta theta iota kappa\n> lambda.\nFine.",
    "Same words here.",
    "> Same words here.\nWhich one?",
    "> The second point is time! Is the third\n> one risk?\nMaybe.",
    "> Words that nobody said.\nHm.",
]


def plain(text, own):
    return " ".join(" ".join(x.lstrip(">") for x in text.split("\n") if x.startswith(">") != own).lower().split())


def test_partial_quotes(spark):
    df = spark.createDataFrame([(1, i, "user", x) for i, x in enumerate(TURNS)], "conv_id long, turn long, role string, text string")
    got = {r.turn: r.reply_to for r in quotes.linked(df).collect()}
    want = {}
    for i, x in enumerate(TURNS):
        quote = plain(x, False)
        want[i] = max((j for j in range(i) if quote and quote in plain(TURNS[j], True)), default=None)
    assert [want[i] for i in (3, 4, 6, 7, 8)] == [0, 1, 5, 0, None]
    assert got == want


def test_random_conversations(spark):
    """Whole, partial and nested quotes of random messages, a very long text, ties and repeated rows, against a plain search."""
    rng = np.random.default_rng(21)
    rows, want = [], {}
    for conv in range(12):
        bodies = []
        for turn in range(12):
            body = " ".join(f"w{k}" for k in rng.integers(0, 10**6, 8)) + "." if turn != 5 or conv else " ".join(f"long{k}" for k in range(60_000)) + "."
            text, up = body, None
            if bodies and rng.random() < 0.7:
                up = int(rng.integers(0, len(bodies)))
                quote = f"> {bodies[up]}\n"
                if rng.random() < 0.3:  # what the quoted one quotes is quoted again, one level down
                    quote += f">> {bodies[int(rng.integers(0, len(bodies)))]}\n"
                text = quote + body
            bodies.append(body)
            rows.append((conv, turn, "user", text))
            want[conv, turn] = up
    rows += [(99, 0, "user", "Tie one.")] * 700 + [(99, 1, "user", "> Tie one.\nYes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.linked(df).where("conv_id < 99").collect()}
    assert {k: r.reply_to for k, r in got.items()} == want

    def root(k):
        return k[1] if want[k] is None else root((k[0], want[k]))

    assert all(got[k].thread == root(k) for k in want)
    held = sorted(quotes.conversations(df).collect(), key=lambda r: (r.conv_id, r.thread, r.first_turn, r.part))
    assert max(r.n_messages for r in held) < 2 * quotes.MOST_MESSAGES and sum(r.n_messages for r in held) == len(rows)
    for k in {(r.conv_id, r.thread) for r in held if r.conv_id < 99}:
        own = [x for r in held if (r.conv_id, r.thread) == k for x in r.replies]
        turns = [x.turn for x in own]
        assert turns == sorted(t for (c, t) in want if c == k[0] and root((c, t)) == k[1])
        assert all(x.reply_to is None or x.reply_to in turns[: turns.index(x.turn)] for x in own)
    assert not any("> " in line for r in held for line in r.chat.split("\n") if line.startswith(">"))
