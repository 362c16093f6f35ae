"""Answers that stream in pieces: whole lines leave as soon as they are there, with citations as numbers outside code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.operators.views import FENCE
from docloom.session import ship

#: What an answer's state holds: text behind the last line end, the fence that is open, lines that left, and pieces that left.
STATE = "rest string, fence string, line_no int, n long"
LINES = "answer_id {key}, line_no int, line string, code boolean"


def whole_lines(rest: str, fence: str, text: str, final: bool) -> tuple[str, str, list[tuple[str, bool]]]:
    """(rest, fence, lines with whether each is code) after one more piece. Lines end at line feeds; the last one is whole when
    the answer is."""
    *lines, rest = (rest + text).split("\n")
    if final:
        lines, rest = [*lines, rest], ""
    out = []
    for line in lines:
        sign = re.match(FENCE, line)
        out.append((line, bool(fence or sign)))
        if not fence:
            fence = sign[1] if sign else ""
        elif sign and sign[1][0] == fence[0] and len(sign[1]) >= len(fence):
            fence = ""
    return rest, fence, out


def stream_lines(pieces: DataFrame) -> DataFrame:
    """(answer_id, line_no, line, code) of a stream of pieces (answer_id, n, text, final): what operators.views.streamed_lines() gives
    for the whole, line by line. An answer's pieces are numbered from 0 and come in order, several to a batch or one by one; a
    piece that comes again is left out. State is an open line and a fence for each answer, and a mark for one that has ended; feed
    the result to rendered_citations()."""
    ship(pieces.sparkSession)
    kind = pieces.schema["answer_id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, fence, line_no, next_n = state.get if state.exists else ("", "", 0, 0)
        out, ended = [], False
        for n, text, final in sorted(r for f in frames for r in f[["n", "text", "final"]].itertuples(index=False, name=None)):
            if n != next_n or ended:
                continue
            rest, fence, lines = whole_lines(rest, fence, text or "", bool(final))
            next_n, ended = n + 1, bool(final)
            for line, code in lines:
                out.append((key[0], line_no, line, code))
                line_no += 1
        state.update((rest, fence, line_no, -1 if ended else next_n))
        yield pd.DataFrame(out, columns=["answer_id", "line_no", "line", "code"])

    return pieces.groupBy("answer_id").applyInPandasWithState(step, LINES.format(key=kind), STATE, "append", GroupStateTimeout.NoTimeout)
