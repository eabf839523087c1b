"""What a correction did to a token list: a shortest edit script for each text.

Of all scripts with the fewest edits (a token changed, inserted or deleted) those
with the fewest deletions count, so one token put in front of others is one
insertion, and a deletion is only told where nothing else explains the lists. The
search is a dynamic programme over a band of diagonals, for many texts of an Arrow
batch at once. A band is wide enough if no script that leaves it can cost less: what
it has cost up to the edge is known, and behind it each token that the other list
lacks takes an edit. Until then the band is widened, so its width follows the shifts
between the lists, not the number of changes. Long lists far apart are split in the
middle, so that memory grows with their length alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: ``at`` is a place in the list before, from 0; an insertion stands in front of it.
SCRIPT_TYPE = "array<struct<op:string,at:bigint,before:string,after:string>>"
AUDIT_TYPE = (
    "n_before bigint, n_after bigint, n_changed bigint, n_deleted bigint, n_inserted bigint,"
    f" flag_shorter boolean, flag_deleted boolean, script {SCRIPT_TYPE}"
)
#: Cells of the programme that are kept at once, a byte each.
CELLS = 1 << 27
#: Cells of several pairs that are searched together; each pair holds some rows of numbers besides.
SIDE_CELLS = 1 << 23
#: Tokens of the pairs whose scripts are Python objects at a time.
SLICE_TOKENS = 1 << 19
#: An edit weighs so much, a deletion one more.
EDIT = 1 << 32
FAR = 1 << 60
#: Diagonals beyond those of the first and the last cell, at first; doubled until a band is wide enough.
SLACK = 8

KEEP, DELETE, INSERT = 0, 1, 2


def _lacking(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place of ``a``, how many tokens from there on are nowhere in ``b``."""
    return np.r_[np.cumsum(~np.isin(a, b)[::-1])[::-1], 0]


def _reach(a: np.ndarray, b: np.ndarray, slack: int) -> tuple[int, int]:
    """The diagonals below and above that of the first cell."""
    return max(0, len(a) - len(b)) + slack, max(0, len(b) - len(a)) + slack


def _leaving(edge: np.ndarray, offset: int, up: bool, a: np.ndarray, b: np.ndarray) -> int:
    """The least that a script can cost which leaves the band at one of its edges.

    ``edge`` holds the costs of the cells at that edge, row by row, and the lists are
    whole: an insertion leads out above the band, a deletion below it.
    """
    i = np.arange(len(edge))
    j = i + offset
    there = (j >= 0) & (j + up <= len(b)) & (i + (not up) <= len(a))
    if not there.any():
        return FAR
    i, j = i[there] + (not up), j[there] + up
    shorter = (len(a) - i) - (len(b) - j)
    rest = np.maximum(np.abs(shorter), np.maximum(_lacking(a, b)[i], _lacking(b, a)[j]))
    return int((edge[there] + EDIT + (not up) + rest * EDIT + np.maximum(shorter, 0)).min())


def _band(
    pairs: list[tuple[np.ndarray, np.ndarray]],
    low: int,
    high: int,
    kept: bool,
    whole: list[tuple[np.ndarray, np.ndarray]] | None = None,
) -> tuple[list[np.ndarray], list[int], np.ndarray | None]:
    """Costs along the last row of each pair, what leaving the band costs, and the steps of all cells if ``kept``.

    Cell t of row i stands for the first i tokens before and the first i + t - low after.
    Rows are held less t edits, which makes an insertion, a step to the right, free.
    ``whole`` holds the lists that the pairs are the beginnings of. Pairs come in the
    order of their lists before by length, so those that have ended are the first.
    """
    n = max(len(a) for a, _ in pairs)
    m = max(len(b) for _, b in pairs)
    width = low + high + 1
    before = np.full((len(pairs), n), -1, dtype=np.int64)
    after = np.full((len(pairs), low + max(m, n + high) + 1), -2, dtype=np.int64)
    for g, (a, b) in enumerate(pairs):
        before[g, : len(a)] = a
        after[g, low : low + len(b)] = b
    free = EDIT * np.arange(width)
    row = np.broadcast_to(np.where(free >= EDIT * low, -EDIT * low, FAR), (len(pairs), width))
    last: list[np.ndarray] = []
    steps = np.zeros((len(pairs), n, width), dtype=np.uint8) if kept else None
    edges = np.empty((n + 1, 2, len(pairs)), dtype=np.int64)
    edges[0] = row[:, 0], row[:, -1] + free[-1]
    lengths, gone = [len(a) for a, _ in pairs], 0
    for i in range(1, n + 1):
        while lengths[gone] < i:
            last.append(row[0] + free)
            row, gone = row[1:], gone + 1
        kept_or_changed = row + EDIT * (before[gone:, i - 1, None] != after[gone:, i - 1 : i - 1 + width])
        deleted = row[:, 1:] + (2 * EDIT + 1)
        best = kept_or_changed.copy()
        np.minimum(best[:, :-1], deleted, out=best[:, :-1])
        if i <= low:
            kept_or_changed[:, low - i] = FAR  # nothing of the list after is there to keep
            best[:, low - i] = deleted[:, low - i]
            best[:, : low - i] = FAR
        row = np.minimum.accumulate(best, axis=1)
        edges[i, :, gone:] = row[:, 0], row[:, -1] + free[-1]
        if steps is not None:
            np.multiply(row != kept_or_changed, (row != best).view(np.uint8) + np.uint8(DELETE), out=steps[gone:, i - 1])
    last += list(row + free)
    leaving = []
    for g, (a, b) in enumerate(pairs if whole is None else whole):
        below, above = edges[: len(pairs[g][0]) + 1, :, g].T
        leaving.append(min(_leaving(below, -low, False, a, b), _leaving(above, high, True, a, b)))
    return last, leaving, steps


def _traced(a: np.ndarray, b: np.ndarray, low: int, steps: np.ndarray) -> list[tuple[int, int, int]]:
    """The edits (step, place before, place after) of one pair, from the end back."""
    i, j, edits = len(a), len(b), []
    while i or j:
        step = INSERT if not i else DELETE if not j else steps[i - 1, j - i + low]
        if step == KEEP:
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                edits.append((KEEP, i, j))
        elif step == DELETE:
            i -= 1
            edits.append((DELETE, i, j))
        else:
            j -= 1
            edits.append((INSERT, i, j))
    return edits[::-1]


def _halved(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """The edits of one long pair: the place of the middle token is found first."""
    middle, slack = len(a) // 2, SLACK
    while True:
        low, high = _reach(a, b, slack)
        [head], [out], _ = _band([(a[:middle], b[: middle + high])], low, high, False, [(a, b)])
        [tail], [back], _ = _band([(a[middle:][::-1], b[::-1][: len(a) - middle + high])], low, high, False, [(a[::-1], b[::-1])])
        j = np.arange(max(0, middle - low), min(len(b), middle + high) + 1)
        rest = len(b) - j - (len(a) - middle) + low
        inside = (rest >= 0) & (rest <= low + high)
        j, rest = j[inside], rest[inside]
        costs = head[j - middle + low] + tail[rest]
        cut = j[np.argmin(costs)]
        if costs.min() <= min(out, back):
            break
        slack *= 2
    right = [(step, i + middle, j + cut) for step, i, j in aligned([(a[middle:], b[cut:])])[0]]
    return aligned([(a[:middle], b[:cut])])[0] + right


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[int, int, int]]]:
    """For each pair of lists of numbers its edits in order: (step, place before, place after)."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in pairs]
    left, slack = [], SLACK
    for g, (a, b) in enumerate(pairs):
        # What both lists begin and end with is kept in some shortest script.
        n = min(len(a), len(b))
        head = int(np.argmin(np.r_[a[:n] == b[:n], False]))
        tail = int(np.argmin(np.r_[(a[::-1][: n - head] == b[::-1][: n - head]), False]))
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if not len(a) or not len(b):
            found[g] = [(DELETE, head + i, head) for i in range(len(a))] + [(INSERT, head, head + j) for j in range(len(b))]
        elif len(a) == len(b) and (a != b).sum() == max(_lacking(a, b)[0], _lacking(b, a)[0]):
            found[g] = [(KEEP, head + i, head + i) for i in np.flatnonzero(a != b).tolist()]  # no script has fewer edits
        else:
            left.append((g, head, a, b))

    def alike(row: tuple) -> tuple:
        """Lists whose bands have much the same diagonals, then by length."""
        shift = len(row[3]) - len(row[2])
        return (1 if shift >= 0 else -1) * max(0, abs(shift) - SLACK).bit_length(), len(row[2]), len(row[3]), row[0]

    while left:
        wider, groups = [], []
        for row in sorted(left, key=alike):
            g, head, a, b = row
            low, high = _reach(a, b, slack)
            kind = alike(row)[0]
            if len(a) > 1 and len(a) * (low + high + 1) > CELLS:
                found[g] = [(step, i + head, j + head) for step, i, j in _halved(a, b)]
                continue
            if groups and groups[-1][0] == kind:
                _, least, most, group = groups[-1]
                least, most = max(least, low), max(most, high)
                if (len(group) + 1) * len(a) * (least + most + 1) <= SIDE_CELLS:
                    group.append(row)
                    groups[-1] = kind, least, most, group
                    continue
            groups.append((kind, low, high, [row]))
        for _, low, high, group in groups:
            last, leaving, steps = _band([(a, b) for _, _, a, b in group], low, high, True)
            for place, (g, head, a, b) in enumerate(group):
                if last[place][len(b) - len(a) + low] <= leaving[place]:
                    found[g] = [(step, i + head, j + head) for step, i, j in _traced(a, b, low, steps[place])]
                else:
                    wider.append((g, head, a, b))
        left, slack = wider, 2 * slack
    return found


def _scripts(before: pa.Array, after: pa.Array, kind: pa.DataType) -> pa.Array:
    tokens = pa.concat_arrays([before.flatten(), after.flatten()]).dictionary_encode("encode")
    numbers, words = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary.to_pylist()
    sizes = np.concatenate([side.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for side in (before, after)])
    lists = np.split(numbers, np.cumsum(sizes)[:-1])
    there = [place for place in range(len(before)) if before[place].is_valid and after[place].is_valid]
    pairs = [(lists[place], lists[place + len(before)]) for place in there]
    rows: list[dict | None] = [None] * len(before)
    for place, (b, a), edits in zip(there, pairs, aligned(pairs), strict=True):
        script = [
            {
                "op": ("change", "delete", "insert")[step], "at": i,
                "before": None if step == INSERT else words[b[i]], "after": None if step == DELETE else words[a[j]],
            }
            for step, i, j in edits
        ]
        deleted, inserted = (sum(step == kind_ for step, _, _ in edits) for kind_ in (DELETE, INSERT))
        rows[place] = {
            "n_before": len(b), "n_after": len(a), "n_changed": len(edits) - deleted - inserted, "n_deleted": deleted, "n_inserted": inserted,
            "flag_shorter": len(a) < len(b), "flag_deleted": deleted > 0, "script": script,
        }
    return pa.array(rows, kind)


def edit_audit(before: Column, after: Column) -> Column:
    """The audit of a correction by real edits, with the script itself.

    STRUCT<n_before, n_after, n_changed, n_deleted, n_inserted, flag_shorter,
    flag_deleted, script>. ``flag_deleted`` is the rule that a correction never
    deletes, judged by the script. NULL if either list is NULL; a NULL token equals
    another one. Runs in Arrow batches on the executors.
    """
    schema = StructType.fromDDL(AUDIT_TYPE)
    kind = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def audit(b: pa.Array, a: pa.Array) -> pa.Array:
        tokens = sum(side.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (b, a))
        part = np.cumsum(tokens) // SLICE_TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(b)]
        return pa.concat_arrays([_scripts(b[i:j], a[i:j], kind) for i, j in zip(cuts, cuts[1:])])

    return audit(before, after)


def edit_table(frame: DataFrame, before: str, after: str, id_col: str) -> DataFrame:
    """One row per edit: id, edit_id, op, at, before, after."""
    audits = frame.select(id_col, edit_audit(F.col(before), F.col(after)).alias("_audit"))
    edits = audits.select(id_col, F.posexplode("_audit.script").alias("edit_id", "_edit"))
    return edits.select(id_col, F.col("edit_id").cast("bigint").alias("edit_id"), "_edit.*")
