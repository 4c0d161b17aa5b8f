"""Reads that wait for their parts, in a stream of SAM lines.

A batch groups lines by file and name; a stream keeps the lines of each incomplete
read as state and emits them when all expected places are there, or after ``patience``
of processing time, marked incomplete.  State is kept by read, so it is spread over
executors and survives their loss in the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "input_index int, qname string, ord long, contig string, pos int, rev boolean, cigar string, seq string, aln long, part int, incomplete boolean"


def assembled(stream: DataFrame, patience_ms: int = 60_000) -> DataFrame:
    """Components of complete alignments; the stream has columns input_index, qname, ord,
    contig, pos, rev, cigar, seq, expect (JSON of [[contig, pos, rev], ...])."""
    import json

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        out = []

        def emit(incomplete: bool) -> None:
            out.extend((key[0], key[1], r[0], *r[1], r[2], r[3], held[0][0], k, incomplete) for k, r in enumerate(held))
            held.clear()

        if state.hasTimedOut:
            emit(True)
            state.remove()
        else:
            for frame in frames:
                for r in frame.sort_values("ord").itertuples():
                    held.append([int(r.ord), [r.contig, int(r.pos), bool(r.rev)], r.cigar, r.seq, json.loads(r.expect)])
                    if all(any(o is not c and o[1] == e for o in held) for c in held for e in c[4]):
                        emit(False)
            if held:
                state.update((json.dumps(held),))
                state.setTimeoutDuration(patience_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return stream.groupBy("input_index", "qname").applyInPandasWithState(step, OUT, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)
