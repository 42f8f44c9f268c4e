"""The line template tree against its SQL and by example."""

from __future__ import annotations

import collections
import time

import duckdb
import pyarrow as pa

from roadpass.llm import line_dedup, oracles
from roadpass.llm.queries import REGISTERED
from tests.compare import connect, difference
from tests.llm.samples import documents, prose, texts

SF_DIR = "/root/testdata/sf0.001"
NAME = "op5_log_template_line_dedup"


def log_rows():
    import random

    rng = random.Random(9)
    rows = []
    for i in range(30):
        own = [prose(rng, 12).replace("\n", " ") for _ in range(3)]
        name = "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(4))
        posted = f"Posted here today by {name} at 10:{i:02d} in section {('news', 'sport', 'arts')[i % 3]} of the site"
        rows.append((i, "\n".join([own[0], posted, own[1], "All rights reserved by all of us", own[2]]), "s"))
    copy = "\n".join(prose(rng, 12).replace("\n", " ") for _ in range(5))
    rows += [(100 + i, copy, "s") for i in range(20)]
    rows.append((200, "", "s"))
    rows.append((201, None, "s"))
    rows.append((None, rows[0][1], "s"))
    rows.append((0, rows[0][1], "s"))
    return rows


def test_recurring_templates_go_and_copies_stay(spark):
    frame = documents(spark, log_rows(), clashing=True).drop("n_dropped")
    cut = line_dedup.drop_recurring_lines(frame)
    assert cut.columns == [*frame.columns, "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_dropped, r.text) for r in cut.collect()]
    assert len(got) == len(log_rows())
    for i, dropped, text in got:
        if i is None or i < 100:
            assert dropped == 2 and "Posted" not in text and "rights" not in text and len(text.split("\n")) == 3
        elif i < 201:
            # Exact copies count as one text.
            assert dropped == 0
        else:
            assert text is None and dropped == 0


def letters(i):
    return f"{chr(97 + i % 26)}{chr(97 + i // 26)}"


def test_short_lines_go_and_clashing_columns_stay(spark):
    """A line of one or two words recurs like any other; one of numbers has no constant."""
    rows = [(i, f"{letters(i)} b{letters(i)} c{letters(i)} start\nRead more\nEnd\n{i}\n \nlast {letters(i)}", "s") for i in range(20)]
    got = line_dedup.cut_lines(documents(spark, rows, clashing=True)).collect()
    assert all(r.n_dropped == 2 and r.n_lines == 6 for r in got)
    assert {r.text for r in got} == {t.replace("\nRead more\nEnd", "") for _, t, _ in rows}
    assert all(r.d["n_dropped"] == "x" for r in got)


def test_columns_named_like_results_are_replaced(spark):
    frame = documents(spark, log_rows(), clashing=True).selectExpr("*", "'x' as n_lines", "'x' as marks", "'x' as gone")
    cut = line_dedup.drop_recurring_lines(frame)
    assert cut.columns == [c for c in frame.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert {r.n_lines for r in cut.collect()} == {5, 1, 0}


def test_blocks_blank_lines_and_copies(spark):
    """What stands around a line does not matter; exact copies count once."""
    rows, block = [], "Sign up for our weekly letter\nRead what others say about it\nFollow the news wherever you are"
    for i in range(6):
        own = f"{letters(i)} alpha{letters(i)} beta{letters(i)} gamma{letters(i)}"
        rows.append((i, f"{own}\n{block}\n\nMade available under a free licence\n\nsecond {own}", "s"))
    rows += [(100 + i, "Only copies hold this very line\nand that one too of course", "s") for i in range(40)]
    got = {r.d.doc_id: r for r in line_dedup.cut_lines(documents(spark, rows)).collect()}
    assert all(got[i].n_dropped == 4 and got[i].text.count("\n") == 3 for i in range(6))
    assert all(got[i].n_dropped == 0 for i in got if i >= 100)


def test_a_text_of_very_many_lines_is_cut_in_linear_time(spark):
    begin = time.monotonic()
    lines = [f"x{k}y own{letters(k % 676)}" if k % 2 else f"The same line number of all {letters(k // 2 % 500)}" for k in range(200_000)]
    rows = [(i, "\n".join([*lines, f"tail {letters(i)}"]), "s") for i in range(6)]
    got = line_dedup.cut_lines(documents(spark, rows)).collect()
    assert time.monotonic() - begin < 120
    want = "\n".join(line for line in lines if line.startswith("x"))
    assert all(r.n_lines == 200_001 and r.text.startswith(want[:1000]) and r.n_dropped >= 100_000 for r in got)


def test_sql_gives_the_same_on_awkward_rows(spark):
    for rows in (texts(), log_rows()):
        con = duckdb.connect()
        documents_table = pa.table(
            {
                "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                "text": pa.array([r[1] for r in rows], pa.string()),
            }
        )
        con.register("documents", documents_table)
        want = collections.Counter(map(tuple, con.execute(oracles.LINE_DEDUP).fetchall()))
        cut = line_dedup.drop_recurring_lines(documents(spark, rows))
        got = collections.Counter(
            tuple(r) for r in cut.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)").collect()
        )
        assert got == want


def test_sql_gives_the_same_on_the_tables(spark):
    assert difference(REGISTERED[NAME](spark, SF_DIR), connect(SF_DIR), oracles.sql()[NAME]) is None


def test_main_path_has_no_python(spark):
    plan = line_dedup.drop_recurring_lines(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert line_dedup.drop_recurring_lines(documents(spark, [])).count() == 0


def test_blocks_and_lines_between_blanks_go_when_sources_are_counted(spark):
    import random

    rng = random.Random(4)

    def own(n=25):
        return prose(rng, n).replace("\n", " ")

    block = ["Sign up for our weekly letter", "Read what others say about it", "Follow the news wherever you are"]
    rows = [(i, "\n".join([own(), *block, own()]), "s") for i in range(12)]
    rows += [(100 + i, "\n".join([own(), "", "Made available under a free licence", "", own()]), "s") for i in range(12)]
    rows += [(200 + i, "\n".join([own(), "", "The end of the printed page"]), "s") for i in range(12)]
    # Copies and near copies with a changed word keep their text.
    copied = "\n".join(own() for _ in range(5))
    rows += [(300 + i, copied, "s") for i in range(12)]
    near = [own().split(" ") for _ in range(5)]
    for i in range(12):
        changed = [list(line) for line in near]
        changed[i % 5][i] = f"changed{chr(97 + i)}"
        rows.append((400 + i, "\n".join(" ".join(line) for line in changed), "s"))
    got = {r.d.doc_id: r for r in line_dedup.cut_lines(documents(spark, rows), sources=True).collect()}
    assert [got[i].n_dropped for i in range(12)] == [3] * 12
    assert [got[100 + i].n_dropped for i in range(12)] == [1] * 12
    assert [got[200 + i].n_dropped for i in range(12)] == [1] * 12
    assert all(got[i].n_dropped == 0 for i in got if i >= 300)


def test_copies_do_not_keep_a_line_in_other_documents(spark):
    import random

    rng = random.Random(5)

    def page():
        own = [prose(rng, 25).replace("\n", " ") for _ in range(2)]
        return "\n".join([own[0], "All rights are kept by the owner", own[1]])

    copied = page()
    rows = [(i, page(), "s") for i in range(12)] + [(100 + i, copied, "s") for i in range(60)]
    got = line_dedup.cut_lines(documents(spark, rows), sources=True).collect()
    assert len(got) == 72 and all(r.n_dropped == 1 and "rights" not in r.text for r in got)
