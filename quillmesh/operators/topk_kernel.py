"""Block kernel of the nearest-neighbour operators.

Runs inside Arrow tasks: one block of queries against one batch of items, one
matrix product per vector pair, and only the best ``k`` rows per query leave the
block.  Scores are rounded to nine decimals before ranking so that results do
not depend on how Spark cut the blocks; equal scores rank by item key.  A least score is
held against the score as it is.  Pairs without a usable vector of one size on both sides are no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCORE_DECIMALS = 9
ITEM_BLOCK = 1024
QUERY_BLOCK = 2048
#: Bytes of a packed block of items, about.
BLOCK_BYTES = 2 << 20
#: Queries that are compared with a block at a time, so that the scores of both stay in a core's cache.
VISIT_ROWS = 512
#: Half a step of rounded scores, and more than the error of a product in doubles.
HALF_STEP = 0.5 * 10.0**-SCORE_DECIMALS
SLACK = 1e-12
#: A least score is given in rounded scores of another sum's order.
FLOOR_SLACK = 2e-9
#: Blocks after which queries that are done with are looked for.
REST_VISITS = 16
#: Different vectors of a column that a packing task remembers.
SEEN_VECTORS = 65_536


def _flat(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def unit_rows(column):
    """List column -> (length per row, {length: (row ids, unit row matrix)})."""
    column = _flat(column)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    groups = {}
    for dim in np.unique(lengths):
        if dim <= 0:
            continue
        ids = np.flatnonzero(lengths == dim)
        part = column if len(ids) == len(column) else column.take(pa.array(ids))
        m = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), int(dim))
        # numbers that are NULL, NaN or infinite make a vector unusable
        usable = np.isfinite(m).all(axis=1)
        if not usable.all():
            ids, m = ids[usable], m[usable]
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        groups[int(dim)] = (ids, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))
    return lengths, groups


def tag_matrix(column, vocabulary):
    """Rows x vocabulary indicator matrix of a list<string> column."""
    column = _flat(column)
    out = np.zeros((len(column), len(vocabulary)), dtype=np.float32)
    if len(vocabulary):
        rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
        slots = pc.index_in(column.flatten(), value_set=pa.array(vocabulary, pa.string()))
        known = pc.is_valid(slots).to_numpy(zero_copy_only=False)
        out[rows[known], slots.drop_null().to_numpy(zero_copy_only=False)] = 1.0
    return out


def prepare_queries(table, spec):
    """Query columns as plain arrays (picklable without this module)."""
    q = {"keys": _flat(table.column(spec["query_key"])), "n": table.num_rows, "vectors": {}}
    for _, query_col, _ in spec["vectors"]:
        if query_col not in q["vectors"]:
            q["vectors"][query_col] = unit_rows(table.column(query_col))[1]
    if spec["query_tags"]:
        column = _flat(table.column(spec["query_tags"]))
        vocabulary = sorted({t for t in column.flatten().to_pylist() if t is not None})
        q["vocabulary"] = vocabulary
        q["tags"] = tag_matrix(column, vocabulary)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        q["unfiltered"] = sizes == 0
    if spec["query_order"]:
        q["order"] = _flat(table.column(spec["query_order"])).to_numpy(zero_copy_only=False).astype(np.int64)
    if spec["query_group"]:
        q["group"] = _group(table.column(spec["query_group"]), "query")
    return q


def _group(column, side):
    """Group values as objects; a NULL equals nothing on the other side."""
    return np.array([(side,) if v is None else v for v in column.to_pylist()] + [None], dtype=object)[:-1]


def _scores(q, query_col, items, n_items, min_score):
    out = np.full((q["n"], n_items), -np.inf)
    for dim, (q_ids, q_rows) in q["vectors"][query_col].items():
        if dim in items:
            i_ids, i_rows = items[dim]
            if len(q_ids) == q["n"] and len(i_ids) == n_items:
                out = q_rows @ i_rows.T
            else:
                out[np.ix_(q_ids, i_ids)] = q_rows @ i_rows.T
    if min_score is not None:
        out[out < min_score] = -np.inf
    return np.round(out, SCORE_DECIMALS) + 0.0


def _position(rows):
    """Position of every entry within its run in a sorted row-id array."""
    if len(rows) == 0:
        return np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))


def _block_best(scores, k):
    n = scores.shape[1]
    if n > k:
        floor = np.partition(scores, n - k, axis=1)[:, n - k, None]
        keep = (scores >= floor) & (scores > -np.inf)
    else:
        keep = scores > -np.inf
    rows, cols = np.nonzero(keep)
    best = scores[rows, cols]
    order = np.lexsort((cols, -best, rows))
    order = order[_position(rows[order]) < k]
    return rows[order], cols[order], best[order]


class Best:
    """Running best ``k`` items per query for one vector pair."""

    def __init__(self, k, compact_at):
        self.k, self.compact_at, self.parts, self.size = k, compact_at, [], 0

    def add(self, rows, keys, scores):
        self.parts.append(pa.table({"row": pa.array(rows), "score": pa.array(scores), "key": keys}))
        self.size += len(rows)
        if self.size > self.compact_at:
            self.parts = [self.result()]
            self.size = self.parts[0].num_rows

    def result(self):
        if not self.parts:
            return None
        t = pa.concat_tables(self.parts).sort_by(
            [("row", "ascending"), ("score", "descending"), ("key", "ascending")]
        )
        return t.filter(pa.array(_position(t.column("row").to_numpy()) < self.k))


def item_blocks(batches, spec):
    """Item batches as blocks of bounded size, sorted by key, with unit vectors."""
    for batch in batches:
        for start in range(0, batch.num_rows, ITEM_BLOCK):
            part = batch.slice(start, ITEM_BLOCK)
            part = part.take(pc.sort_indices(_flat(part.column(spec["item_key"]))))
            block = {"keys": _flat(part.column(spec["item_key"])), "n": part.num_rows, "units": {}}
            for _, _, item_col in spec["vectors"]:
                if item_col not in block["units"]:
                    block["units"][item_col] = unit_rows(part.column(item_col))[1]
            if spec["item_tags"]:
                block["tags"] = _flat(part.column(spec["item_tags"]))
            if spec["item_order"]:
                block["order"] = _flat(part.column(spec["item_order"])).to_numpy(zero_copy_only=False).astype(np.int64)
            if spec["item_group"]:
                block["group"] = _group(part.column(spec["item_group"]), "item")
            yield block


def search(q, blocks, spec):
    """Best items per query and vector pair over prepared item blocks."""
    best = {
        name: Best(spec["k"], max(200_000, 4 * q["n"] * spec["k"])) for name, _, _ in spec["vectors"]
    }
    for block in blocks if q["n"] else ():
        blocked = np.zeros((q["n"], block["n"]), dtype=bool)
        if spec["query_tags"]:
            shared = q["tags"] @ tag_matrix(block["tags"], q["vocabulary"]).T
            blocked |= ~((shared > 0) | q["unfiltered"][:, None])
        if spec["query_order"]:
            blocked |= block["order"][None, :] >= q["order"][:, None]
        if spec["query_group"]:
            blocked |= block["group"][None, :] == q["group"][:, None]
        if blocked.all():
            continue
        for name, query_col, item_col in spec["vectors"]:
            s = _scores(q, query_col, block["units"][item_col], block["n"], spec["min_score"])
            s[blocked] = -np.inf
            rows, cols, top = _block_best(s, spec["k"])
            if len(rows):
                best[name].add(rows, block["keys"].take(pa.array(cols)), top)
    for name, found in best.items():
        t = found.result()
        if t is not None and t.num_rows:
            rank = _position(t.column("row").to_numpy()) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    q["keys"].take(_flat(t.column("row"))),
                    pa.array([name] * t.num_rows, pa.string()),
                    _flat(t.column("key")),
                    _flat(t.column("score")),
                    pa.array(rank.astype(np.int32)),
                ],
                names=[spec["query_key"], "vec_name", spec["item_key"], "score", "rank"],
            )


class Running:
    """The best ``k`` items per query so far, as places in the order of item keys, and the score that a new one must beat.

    Items come in any order; an equal score counts if its place is earlier than that of the last one kept.
    """

    def __init__(self, n, k):
        self.n, self.k = n, k
        self.floor, self.last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new, self.size = [], 0

    def add(self, rows, places, scores):
        """Candidates; they are merged once there are as many as half of what is kept."""
        if len(rows):
            self.new.append((rows, places, scores))
            self.size += len(rows)
            if self.size > max(20_000, self.n * self.k // 2):
                self.merge()

    def merge(self):
        if self.new:
            rows, places, scores = (np.concatenate(x) for x in zip(self.best, *self.new, strict=True))
            order = np.lexsort((places, -scores, rows))
            at = _position(rows[order])
            order, at = order[at < self.k], at[at < self.k]
            self.best = rows, places, scores = rows[order], places[order], scores[order]
            full = at == self.k - 1
            self.floor[rows[full]], self.last[rows[full]] = scores[full], places[full]
            self.new, self.size = [], 0
        return self.best


def _allowed(q, block, spec, rows, cols):
    """Which pairs of a query and an item of the block the filters let through."""
    keep = np.ones(len(rows), dtype=bool)
    if spec["query_tags"]:
        keep &= q["unfiltered"][rows] | (np.einsum("ij,ij->i", q["tags"][rows], block["marks"][cols]) > 0)
    if spec["query_order"]:
        keep &= block["order"][cols] < q["order"][rows]
    if spec["query_group"]:
        keep &= block["group"][cols] != q["group"][rows]
    return keep


def _all_allowed(q, block, spec, rows, cols):
    """The same for all pairs of some queries and items."""
    keep = np.ones((len(rows), len(cols)), dtype=bool)
    if spec["query_tags"]:
        keep &= q["unfiltered"][rows][:, None] | (q["tags"][rows] @ block["marks"][cols].T > 0)
    if spec["query_order"]:
        keep &= block["order"][cols][None, :] < q["order"][rows][:, None]
    if spec["query_group"]:
        keep &= block["group"][cols][None, :] != q["group"][rows][:, None]
    return keep


def _few_per_row(scores, places, keep, k):
    """Leave the ``k`` best of the kept entries in every row that has more."""
    crowded = np.flatnonzero(keep.sum(axis=1) > k)
    if len(crowded):
        s = np.where(keep[crowded], np.round(scores[crowded], SCORE_DECIMALS) + 0.0, -np.inf)
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above, order = s > floor, np.argsort(places, kind="stable")
        ties = np.zeros_like(above)
        ties[:, order] = (s[:, order] == floor) & (s[:, order] > -np.inf)
        first = np.cumsum(ties[:, order], axis=1) <= k - above.sum(axis=1, keepdims=True)
        ties[:, order] &= first
        keep[crowded] = above | ties
    return keep


def _marked(marks, n):
    """Places of the few marks among the first ``n``, looked for eight at a time; there is room for the last eight."""
    marks[n : -(-n // 8) * 8] = False
    words = np.flatnonzero(marks[: -(-n // 8) * 8].view(np.uint64))
    at = np.flatnonzero(marks.reshape(-1, 8)[words])
    return words[at >> 3] * 8 + (at & 7)


def _visit(q, rows, pick, q_units, block, cols, i_units, spec, running, room):
    """Compare some queries with some items of a block: vectors in single precision first, the few that can count exactly.

    ``q_units`` and ``i_units`` are pairs of the unit rows in double and single precision; ``rows`` are the queries at ``pick`` of the former.
    ``room`` is for rough scores and marks.  A row whose best rough score is too low is done with; the others are looked through.
    """
    floor, places = running.floor[rows], block["places"][cols]
    least = -np.inf if spec["min_score"] is None else spec["min_score"] - SLACK
    margin = np.float32(1.2e-7 * (q_units[0].shape[1] + 8))
    flat = spec.get("flat", False)
    low = np.full(len(rows), least) if flat else np.maximum(floor - HALF_STEP - SLACK, least)
    bar = (low - margin).astype(np.float32)
    rough = room[0][: len(rows) * len(cols)].reshape(len(rows), len(cols))
    np.matmul(q_units[1][pick], i_units[1].T, out=rough)
    hot = np.flatnonzero(rough.max(axis=1) > bar)
    if not len(hot):
        return
    at = np.arange(pick.start, pick.start + len(rows)) if isinstance(pick, slice) else pick
    if 2 * len(hot) < len(rows):
        rows, at, floor, low, bar, rough = (x[hot] for x in (rows, at, floor, low, bar, rough))
    near = room[1][: rough.size].reshape(rough.shape)
    np.greater(rough, bar[:, None], out=near)
    filtered = spec["query_tags"] or spec["query_order"] or spec["query_group"]
    if np.count_nonzero(near) * 16 > near.size and not flat and spec["k"] < len(cols):
        # what the block itself holds sets a higher bar
        if filtered:
            rough[~_all_allowed(q, block, spec, rows, cols)] = -np.inf
        kth = np.partition(rough, len(cols) - spec["k"], axis=1)[:, len(cols) - spec["k"]]
        bar = np.maximum(bar, kth - 2 * margin)
        np.greater(rough, bar[:, None], out=near)
    if np.count_nonzero(near) * 16 <= near.size:
        r, c = np.divmod(_marked(room[1], near.size), len(cols))
        ok = _allowed(q, block, spec, rows[r], cols[c])
        r, c = r[ok], c[ok]
        exact = np.einsum("ij,ij->i", q_units[0][at[r]], i_units[0][c])
    else:
        s = q_units[0][at] @ i_units[0].T
        keep = s > np.maximum(np.where(flat & (floor == 0), np.inf, floor + HALF_STEP - SLACK), least)[:, None]
        last = running.last[rows]
        if places.min() < last.max():
            keep |= (s > low[:, None]) & (places[None, :] < last[:, None])
        if spec["min_score"] is not None:
            keep &= s >= spec["min_score"]
        keep &= _all_allowed(q, block, spec, rows, cols)
        r, c = np.nonzero(_few_per_row(np.zeros_like(s) if flat else s, places, keep, spec["k"]))
        exact = s[r, c]
    if spec["min_score"] is not None:
        ok = exact >= spec["min_score"]
        r, c, exact = r[ok], c[ok], exact[ok]
    exact = np.zeros(len(exact)) if flat else np.round(exact, SCORE_DECIMALS) + 0.0
    counts = (exact > floor[r]) | ((exact == floor[r]) & (places[c] < running.last[rows[r]]))
    running.add(rows[r[counts]], places[c[counts]], exact[counts])


def _both(groups):
    return {dim: (ids, rows, rows.astype(np.float32)) for dim, (ids, rows) in groups.items()}


class Search:
    """Best items for the queries of one table; blocks of items come in any order, with ``places`` in the order of keys.

    ``lists``: for every query the lists that it opens (a matrix of queries and lists); a block then is of one ``list``.
    Without them blocks come in the order of keys, and queries that nothing can improve any more are left out from then on.
    With ``query_floor``, items of a lower score than a query's are not looked for; with ``settle``, a query is done with once
    an item beats that score.
    """

    def __init__(self, q_table, spec, opened=None):
        self.q, self.spec, self.opened = prepare_queries(q_table, spec), spec, opened
        both = {name: _both(groups) for name, groups in self.q["vectors"].items()}
        self.sides = {name: dict(both[query_col]) for name, query_col, _ in spec["vectors"]}
        self.running = {name: Running(self.q["n"], spec["k"]) for name, _, _ in spec["vectors"]}
        self.room = np.empty(VISIT_ROWS * ITEM_BLOCK, np.float32), np.empty(VISIT_ROWS * ITEM_BLOCK, bool)
        self.visits, self.enough = 0, np.full(self.q["n"], 1.0)
        if spec.get("query_floor"):
            least = _flat(q_table.column(spec["query_floor"])).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            for running in self.running.values():
                running.floor[:] = least - FLOOR_SLACK
            if spec.get("settle"):
                self.enough = np.minimum(least + FLOOR_SLACK, 1.0)

    def _rest(self, block):
        """Leave out queries that are done with: a full row of perfect scores ahead of the block, or a settled one."""
        for name, sides in self.sides.items():
            running = self.running[name]
            if self.spec.get("settle"):
                running.merge()
            perfect = (running.floor >= 1.0) & (running.last < block["places"].min())
            done = perfect | (running.floor > self.enough)
            for dim, (ids, *units) in sides.items():
                still = np.flatnonzero(~done[ids])
                if 8 * len(still) < 7 * len(ids):
                    sides[dim] = ids[still], *[u[still] for u in units]

    def visit(self, block):
        q, spec = self.q, self.spec
        if spec["query_tags"] and block.get("vocabulary") is not q["vocabulary"]:
            block = block | {"marks": tag_matrix(block["tags"], q["vocabulary"]), "vocabulary": q["vocabulary"]}
        self.visits += 1
        if self.opened is None and self.visits % REST_VISITS == 0:
            self._rest(block)
        for name, _, item_col in spec["vectors"]:
            for dim, (i_ids, *i_units) in block["both"][item_col].items():
                if dim not in self.sides[name] or not len(i_ids):
                    continue
                ids, *units = self.sides[name][dim]
                some = None
                if self.opened is not None:
                    some = self.opened[ids, block["list"]]
                    if spec.get("flat", False):
                        # earlier places only, and only those that a full row still takes
                        some &= (q["order"][ids] > block["order"].min()) & (self.running[name].last[ids] > block["places"].min())
                    some = None if some.all() else np.flatnonzero(some)
                for at in range(0, len(ids) if some is None else len(some), VISIT_ROWS):
                    pick = slice(at, min(at + VISIT_ROWS, len(ids))) if some is None else some[at : at + VISIT_ROWS]
                    _visit(q, ids[pick], pick, units, block, i_ids, i_units, spec, self.running[name], self.room)

    def result(self, keys, places=None):
        """Record batches of the best rows; ``keys`` by place, or beside their sorted ``places``."""
        for name, running in self.running.items():
            rows, at, scores = running.merge()
            if len(rows):
                if places is not None:
                    at = np.searchsorted(places, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        self.q["keys"].take(pa.array(rows)),
                        pa.array([name] * len(rows), pa.string()),
                        keys.take(pa.array(at)),
                        pa.array(scores),
                        pa.array((_position(rows) + 1).astype(np.int32)),
                    ],
                    names=[self.spec["query_key"], "vec_name", self.spec["item_key"], "score", "rank"],
                )


def placed_blocks(table, spec, at=0, places=None):
    """Blocks of a table of items with their places: the numbers given, or from ``at`` on for a table in the order of keys."""
    if places is None:
        places = np.arange(at, at + table.num_rows, dtype=np.int64)
    for start in range(0, table.num_rows, ITEM_BLOCK):
        part = table.slice(start, ITEM_BLOCK)
        block = {"places": places[start : start + ITEM_BLOCK], "both": {}}
        for _, _, item_col in spec["vectors"]:
            if item_col not in block["both"]:
                block["both"][item_col] = _both(unit_rows(part.column(item_col))[1])
        if spec["item_tags"]:
            block["tags"] = _flat(part.column(spec["item_tags"]))
        if spec["item_order"]:
            block["order"] = _flat(part.column(spec["item_order"])).to_numpy(zero_copy_only=False).astype(np.int64)
        if spec["item_group"]:
            block["group"] = _group(part.column(spec["item_group"]), "item")
        yield block


def in_key_order(table, spec):
    return table.take(pc.sort_indices(_flat(table.column(spec["item_key"]))))


def search_table(q_table, keys, blocks, spec):
    """All queries of a table against reusable blocks of the items whose sorted keys are given, in query blocks of bounded size."""
    for start in range(0, q_table.num_rows, 4 * QUERY_BLOCK):
        search = Search(q_table.slice(start, 4 * QUERY_BLOCK), spec)
        for block in blocks:
            search.visit(block)
        yield from search.result(keys)


class Repeated:
    """Which vectors of a column were seen ``most`` times before; as many different ones are remembered as fit."""

    def __init__(self, most):
        self.most, self.seen = most, {}

    def without(self, column):
        """The column with NULL in place of vectors that were seen often enough."""
        column = _flat(column)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        whole, ends = column.flatten(), np.cumsum(lengths)
        if whole.null_count:
            return column
        raw, width = np.ascontiguousarray(whole.to_numpy(zero_copy_only=False)), whole.type.bit_width // 8
        data, drop = memoryview(raw).cast("B"), np.zeros(len(column), bool)
        for row in np.flatnonzero(lengths):
            key = bytes(data[(ends[row] - lengths[row]) * width : ends[row] * width])
            count = self.seen.get(key, 0)
            drop[row] = count >= self.most
            if not drop[row] and (count or len(self.seen) < SEEN_VECTORS):
                self.seen[key] = count + 1
        return pc.if_else(pa.array(drop), pa.scalar(None, column.type), column) if drop.any() else column


def alike(spec):
    """How many of equal vectors of which columns can be in a list; None with a filter or an order, which may leave out the first ones."""
    filtered = spec["query_tags"] or spec["query_order"] or spec["query_group"]
    return None if filtered else spec["k"], tuple(dict.fromkeys(v[2] for v in spec["vectors"]))


def without_repeated(table, most, vec_cols):
    """A table in the order of keys, with NULL in place of vectors that ``most`` rows before have as well."""
    for name in vec_cols if most else ():
        table = table.set_column(table.schema.get_field_index(name), name, Repeated(most).without(table.column(name)))
    return table


def packed(batches, most=None, vec_cols=()):
    """Rows as blocks of bounded size, each one binary value, in their order.

    With ``most``, equal vectors of a column beyond the first so many become NULL: rows ahead of them have the same scores,
    so they are in nobody's list.
    """
    repeated = {c: Repeated(most) for c in vec_cols} if most else {}
    for batch in batches:
        if not batch.num_rows:
            continue
        if repeated:
            batch = pa.RecordBatch.from_arrays([repeated[n].without(c) if n in repeated else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)
        rows = min(ITEM_BLOCK, max(1, BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes)))
        blocks = []
        for start in range(0, batch.num_rows, rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(start, rows))
            blocks.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["_block"])


def stored_blocks(files):
    """Blocks of stored files, in the order of the files; a few are held at a time."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for uri in files:
        system, path = pafs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=8, columns=["_block"]):
                yield from batch.column(0)


def _streamed(batches, q_names, begin):
    """Rows of queries (side 0) come first, then blocks of items (side 1): a search of the former, and the latter."""
    parts, search = [], None
    for batch in batches:
        side = batch.column("_side").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(side, 1))
        if cut:
            q = batch.slice(0, cut)
            parts.append(pa.RecordBatch.from_arrays([q.column("q_" + c) for c in q_names], names=q_names))
        if cut == batch.num_rows or not parts:
            continue
        if search is None:
            search = begin(pa.Table.from_batches(parts))
        for value in batch.column("_block").slice(cut):
            yield search, value


def _read(batches, files, begin):
    """The same with queries only in the batches, and blocks in files."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        search = begin(pa.Table.from_batches(parts))
        for value in stored_blocks(files):
            yield search, value


def stream_search(batches, q_names, spec, opener=None, files=None):
    """Search over one partition of queries and all blocks of items, in the order of keys, or of lists.

    Blocks are as ``packed`` made them, in ``files`` or in the batches after the queries.  Of the items
    only a batch is held at a time, and the keys.  With ``opener``, which tells the lists that each query of a table opens,
    items have ``list`` and ``place``.
    """
    keys, all_places, at, search = [], [], 0, None

    def begin(table):
        return Search(table, spec, opener(table) if opener else None)

    for search, value in _streamed(batches, q_names, begin) if files is None else _read(batches, files, begin):  # noqa: B007
        table = pa.ipc.open_stream(value.as_buffer()).read_all()
        keys.append(table.column(spec["item_key"]))
        if opener:
            places, lists = (table.column(c).to_numpy() for c in ("place", "list"))
            all_places.append(places)
            for piece in np.split(np.arange(len(lists)), np.flatnonzero(np.diff(lists)) + 1):
                of = int(lists[piece[0]])
                if not search.opened[:, of].any():
                    continue
                for block in placed_blocks(table.slice(int(piece[0]), len(piece)), spec, places=places[piece]):
                    search.visit(block | {"list": of})
        else:
            for block in placed_blocks(table, spec, at):
                search.visit(block)
        at += table.num_rows
    if search is not None:
        names = pa.chunked_array([c for k in keys for c in k.chunks]).combine_chunks()
        if not opener:
            yield from search.result(names)
        else:
            places = np.concatenate(all_places)
            order = np.argsort(places, kind="stable")
            yield from search.result(names.take(pa.array(order)), places[order])


def listed(count):
    """Opener of the ``lists`` of each query, out of ``count``."""

    def opened(table):
        out = np.zeros((table.num_rows, count), dtype=bool)
        lists = _flat(table.column("lists"))
        out[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)] = True
        return out

    return opened


def reached(centres, radii, vec_col, reach):
    """Opener of all lists that can hold a vector within the angle ``reach`` of each query, but for its ``lists``."""

    def opened(table):
        out = np.zeros((table.num_rows, len(centres)), dtype=bool)
        far = _flat(table.column(reach)).to_numpy(zero_copy_only=False)
        ids, rows = unit_rows(table.column(vec_col))[1].get(centres.shape[1], (np.zeros(0, np.int64), None))
        for start in range(0, len(ids), ROUTE_ROWS):
            some = ids[start : start + ROUTE_ROWS]
            out[some] = within(rows[start : start + ROUTE_ROWS] @ centres.T, radii, far[some][:, None])
        return out & ~listed(len(centres))(table)

    return opened


def as_table(batches, schema):
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, names=schema.names) for b in batches]).cast(
        schema
    ) if batches else schema.empty_table()


def add_buckets(batch, vec_col, planes, bands):
    """Append the list column ``buckets`` (one bucket number per band)."""
    dim, width = planes.shape
    bits = width // bands
    n = batch.num_rows
    numbers = np.zeros((n, bands), dtype=np.int32)
    known = np.zeros(n, dtype=bool)
    groups = unit_rows(batch.column(vec_col))[1]
    if dim in groups:
        ids, rows = groups[dim]
        sides = (rows @ planes >= 0).reshape(len(ids), bands, bits)
        numbers[ids] = (sides * (1 << np.arange(bits))).sum(axis=2)
        known[ids] = True
    offsets = pa.array(np.r_[0, np.cumsum(np.where(known, bands, 0))].astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(numbers[known].ravel()))
    return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "buckets"])


#: Rows whose distances to all centres are held at a time.
ROUTE_ROWS = 1024


def fit_centres(units, count, rounds):
    """Spherical k-means from the first ``count`` rows; an empty group keeps its centre.

    Scores are rounded before a centre is chosen (ties: the first), and centres after each round, so that
    the result does not depend on the order of sums.
    """
    centres = units[:count].round(6)
    for _ in range(rounds):
        home = np.concatenate([_rounded(units[a : a + ROUTE_ROWS] @ centres.T).argmax(axis=1) for a in range(0, len(units), ROUTE_ROWS)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, units)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0), centres).round(6)
    return centres


def _rounded(scores):
    return np.round(scores, SCORE_DECIMALS) + 0.0


def within(scores, radii, far):
    """Which lists can hold a vector within the angle ``far``, by the cosines of their centres."""
    # the margin covers the rounding of scores, whose angles err most near 0
    return np.arccos(np.clip(_rounded(scores), -1, 1)) - radii <= far + 1e-4


def routed(batches, vec_col, centres, radii, reach, nearest):
    """Append ``lists`` and ``angle`` (to the nearest centre) to every row.

    ``lists``: the ``nearest`` centres, best first; or, with ``radii``, every list that can hold a vector
    within the angle ``reach`` (a number or a column) of the row's, which the triangle inequality on angles tells.
    Vectors of another size than the centres have no list.
    """
    for whole in batches:
        for start in range(0, whole.num_rows, ROUTE_ROWS):
            batch = whole.slice(start, ROUTE_ROWS)
            sizes, lists = np.zeros(batch.num_rows, np.int64), np.zeros(0, np.int32)
            angle = np.full(batch.num_rows, np.nan)
            groups = unit_rows(batch.column(vec_col))[1]
            if len(centres) and centres.shape[1] in groups:
                ids, rows = groups[centres.shape[1]]
                scores = _rounded(rows @ centres.T)
                angles = np.arccos(np.clip(scores, -1, 1))
                angle[ids] = angles.min(axis=1)
                if radii is None:
                    some = scores.argmax(axis=1)[:, None] if nearest == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :nearest]
                    sizes[ids], lists = some.shape[1], some.ravel().astype(np.int32)
                else:
                    far = reach if isinstance(reach, float) else batch.column(reach).to_numpy(zero_copy_only=False)[ids][:, None]
                    near = within(scores, radii, far)
                    sizes[ids], lists = near.sum(axis=1), np.nonzero(near)[1].astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(lists, pa.int32()))
            known = pa.array(angle, pa.float64(), mask=np.isnan(angle))
            yield pa.RecordBatch.from_arrays([*batch.columns, column, known], names=[*batch.schema.names, "lists", "angle"])


def curve_counts(batches, query_vec, centres, sizes):
    """(probes, pairs, hits) of a task's queries, which have the lists of their true neighbours as ``home``."""
    pairs, hits, rows = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64), 0
    for batch in routed(batches, query_vec, centres, None, None, len(centres)):
        opened = np.flatnonzero(pc.list_value_length(batch.column("lists")).to_numpy(zero_copy_only=False) > 0)
        rows += len(opened)
        order = batch.column("lists").flatten().to_numpy(zero_copy_only=False).reshape(len(opened), len(centres))
        pairs += sizes[order].sum(axis=0)
        at = np.empty_like(order)
        np.put_along_axis(at, order, np.arange(len(centres), dtype=order.dtype)[None, :], axis=1)
        home = batch.column("home").take(pa.array(opened))
        found = at[pc.list_parent_indices(home).to_numpy(zero_copy_only=False), home.flatten().to_numpy(zero_copy_only=False)]
        hits += np.bincount(found, minlength=len(centres))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(pairs), pa.array(hits)], names=["probes", "pairs", "hits"])


def earliest_near(q_table, i_table, threshold, count):
    """For each row of (ord, vec), the ``count`` rows of smallest ``other`` before it with a cosine of the threshold or more."""
    found = []
    items = unit_rows(i_table.column("vec"))[1]
    others = _flat(i_table.column("other")).to_numpy(zero_copy_only=False)
    for start in range(0, q_table.num_rows, QUERY_BLOCK):
        part = q_table.slice(start, QUERY_BLOCK)
        own = _flat(part.column("ord")).to_numpy(zero_copy_only=False)
        for dim, (ids, rows) in unit_rows(part.column("vec"))[1].items():
            if dim not in items:
                continue
            i_ids, i_rows = items[dim]
            order = np.argsort(others[i_ids], kind="stable")
            i_ids, i_rows = i_ids[order], i_rows[order]
            taken = np.zeros(len(ids), np.int64)
            for at in range(0, len(i_ids), ITEM_BLOCK):
                block = others[i_ids[at : at + ITEM_BLOCK]]
                active = np.flatnonzero((taken < count) & (own[ids] > block[0]))
                if not len(active):
                    continue
                near = (rows[active] @ i_rows[at : at + ITEM_BLOCK].T >= threshold) & (block[None, :] < own[ids[active]][:, None])
                near &= near.cumsum(axis=1) + taken[active][:, None] <= count
                r, c = np.nonzero(near)
                taken[active] += near.sum(axis=1)
                found.append((own[ids[active[r]]], block[c]))
    pairs = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2
    return pa.table({"ord": pa.array(pairs[0], pa.int64()), "other": pa.array(pairs[1], pa.int64())})
