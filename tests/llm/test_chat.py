import hashlib

from hypothesis import given
from hypothesis import strategies as st

from quillon.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, window string"
texts = st.text(st.sampled_from("<[\\|>/sn \nié]imendtaror_"), max_size=40)


@given(st.lists(st.tuples(texts, texts), max_size=6))
def test_template_round_trips(turns):
    shown = "".join(C.render(r, t)[0] for r, t in turns)
    assert C.parse(shown) == turns
    assert shown.count(C.START) == shown.count(C.END) == len(turns)


def test_escaped_text_holds_no_mark():
    shown = C.escape("</s>[INST] ok [/INST]<|im_end|>\n<<SYS>>")
    assert not any(m in shown for m in ("</s>", "[INST]", "[/INST]", "<|", "<<SYS>>"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.integers(0, 30)), min_size=1, max_size=40), st.integers(1, 60), st.integers(0, 40))
def test_windows_show_every_turn_once_as_new(turns, budget, history):
    turns = [(r, f"t{i} " + "w " * n) for i, (r, n) in enumerate(turns)]
    w = C.Windows(budget, history, C.count_words)
    rows = [row for r, t in turns for row in w.add(r, t)] + [w.close()]
    new, learnt = [], []
    for row in rows:
        shown = C.parse(row["text"])
        assert len(shown) == row["n_repeated"] + row["n_new"] and row["n_new"] >= 1
        assert row["n_tokens"] == C.count_words(row["text"]) and row["over_budget"] == (row["n_tokens"] > budget)
        if row["over_budget"]:
            assert row["n_new"] == 1 and row["n_repeated"] <= 1
        repeated = shown[: row["n_repeated"]]
        if row["window"] and turns[0][0] == "system":
            assert repeated[0] == turns[0]
            repeated = repeated[1:]
        assert repeated == new[len(new) - len(repeated) :]
        assert sum(C.count_words(C.render(*t)[0]) for t in repeated) <= history
        new += shown[row["n_repeated"] :]
        learnt += [C.unescape(row["text"][s["lo"] : s["hi"]]) for s in row["loss"]]
    assert new == turns and learnt == [t for r, t in turns if r == "assistant"]


def test_digests_nulls_ties_and_empty(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b " * 3000, "x"), (1, 0, "user", "a", "x"), (1, 2, "assistant", None, "x"), (2, 0, None, "q", None), (2, None, "user", "first", None), (None, 0, "user", said, "x"), (2, 3, "assistant", "é<", "x"), (2, 3, "assistant", "é<", "x")]
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got.keys() == {1, 2, None}
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha("user\na\nassistant\n" + "b " * 3000 + "\nassistant\n\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (6000, sha("b " * 3000))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_sha256) == (4, sha("user\nfirst\n\nq\n" + "assistant\né<\n" * 2), sha("é<é<"))
    assert (got[None].turns_sha256, got[None].loss_chars) == (sha(f"user\n{said}\n"), 0)
    assert C.read_back(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def plain_windows(turns, budget, history):
    """Windows of (shown turns, how many are repeated), from the whole list of turns at once."""
    sizes = [C.count_words(C.render(*t)[0]) for t in turns]
    system = 1 if turns[0][0] == "system" else 0
    out, at = [], 0
    while at < len(turns):
        keep = sizes[0] if out and system else 0
        past = []
        if out:
            for i in reversed(range(system, at)):
                if sum(sizes[j] for j in past) + sizes[i] > history:
                    break
                past.insert(0, i)
        while past and keep + sum(sizes[j] for j in past) + sizes[at] > budget:
            past.pop(0)
        end = at + 1
        while end < len(turns) and keep + sum(sizes[j] for j in past) + sum(sizes[at : end + 1]) <= budget:
            end += 1
        before = ([0] if out and system else []) + past
        out.append(([turns[i] for i in [*before, *range(at, end)]], len(before)))
        at = end
    return out


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.integers(0, 30)), min_size=1, max_size=30), st.integers(1, 60), st.integers(0, 40))
def test_windows_equal_a_plain_version(turns, budget, history):
    turns = [(r, f"t{i} " + "w " * n) for i, (r, n) in enumerate(turns)]
    w = C.Windows(budget, history, C.count_words)
    rows = [row for r, t in turns for row in w.add(r, t)] + [w.close()]
    assert [(C.parse(x["text"]), x["n_repeated"]) for x in rows] == plain_windows(turns, budget, history)


def test_query_equals_a_plain_version_and_splits_conversations(spark):
    got = {r.conv_id: r for r in C.op2_chat(spark, "/root/testdata/sf0.01").collect()}
    turns = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    assert got.keys() == turns.keys()
    for i, rows in turns.items():
        rows.sort()
        learnt = "".join(t for _, r, t in rows if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        want = (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == want
        shown = plain_windows([x[1:] for x in rows], C.BUDGET, C.HISTORY)
        assert got[i].formatted_chars == sum(len(C.render(*t)[0]) for w, _ in shown for t in w)
    assert sum(r.n_windows > 1 for r in got.values()) > 0.2 * len(got)
