"""Small tables <-> text.

Table form: ``(table_id, row_idx INT, header ARRAY<STRING>, cells ARRAY<STRING>)``,
one row per table row; many tables live in one DataFrame.

Per-table text is assembled with one ``groupBy(table_id)`` whose group is a single table, for tables within the size
gate; :func:`render_large_tables` puts it together from ranges of rows, for tables of any size. No function drops
tables; :func:`size_gate` (F3) reports the large ones and :func:`gated` leaves them out on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.constants import DOC_RANDOM_SEED, MAX_TABLE_COLS, MAX_TABLE_ROWS, MIN_ALPHA_COLUMNS, MISSING_WORDS
from quire.functions.ids import hash_choice, seeded_hash
from quire.functions.text import csv_cell, strip_ws, token_count
from quire.operators.ranges import CHUNK_BYTES, joined_lines, stored_lines, text_chunks, text_digests, whole_texts

# ---------------------------------------------------------------- F3 / F4 gates


def size_gate(rows: DataFrame, max_rows: int = MAX_TABLE_ROWS, max_cols: int = MAX_TABLE_COLS) -> DataFrame:
    """per table, row and column counts, accepted flag and a rejection reason."""
    st = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.max(F.size("header")).alias("n_cols"))
    nr, nc = F.col("n_rows"), F.col("n_cols")
    reason = (F.when(nr > max_rows, F.format_string("rows %d > %d", nr, F.lit(max_rows)))
              .when(nc > max_cols, F.format_string("columns %d > %d", nc, F.lit(max_cols))))
    return st.select("table_id", "n_rows", nc.cast("bigint").alias("n_cols"),
                     reason.isNull().alias("accepted"), reason.alias("reason"))


def gated(rows: DataFrame, max_rows: int = MAX_TABLE_ROWS, max_cols: int = MAX_TABLE_COLS) -> DataFrame:
    """F3 applied: the rows of tables that pass the size gate (left-semi join on the gate result)."""
    ok = size_gate(rows, max_rows, max_cols).where("accepted").select("table_id")
    return rows.join(ok, "table_id", "left_semi")


def letter_columns(rows: DataFrame, k: int = MIN_ALPHA_COLUMNS) -> DataFrame:
    """number of columns with a letter in some non-null cell, and the ``>= k`` gate.

    Each row keeps only the positions of its cells with a letter; their distinct count per table
    is one partial (map-side) aggregate and one small shuffle, so a huge or skewed table costs no
    more than any other, and tables of any width are counted exactly.
    """
    at = F.filter(F.transform("cells", lambda c, j: F.when(c.rlike("[A-Za-z]"), j)), lambda j: j.isNotNull())
    cells = rows.select("table_id", F.explode_outer(at).alias("_j"))
    per_table = cells.groupBy("table_id").agg(F.count_distinct("_j").cast("int").alias("n_alpha_cols"))
    return per_table.select("table_id", "n_alpha_cols", (F.col("n_alpha_cols") >= k).alias("passes"))


# ---------------------------------------------------------------- R1: rows -> text


def _collected(rows: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per table: header and the row cells ordered by ``row_idx``."""
    aggs = [F.max("header").alias("header"),  # one header per table; max keeps it deterministic
            F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("_rows")]
    aggs += [v.alias(k) for k, v in (extra or {}).items()]
    return rows.groupBy("table_id").agg(*aggs)


def _join_cells(cells: Column, delimiter: str) -> Column:
    return F.array_join(F.transform(cells, lambda c: csv_cell(c, delimiter)), delimiter)


def plain_text(header: Column, rows: Column, delimiter: str = "|") -> Column:
    """Delimited text: header line, one line per row, trailing line break."""
    lines = F.concat(F.array(_join_cells(header, delimiter)),
                     F.transform(rows, lambda r: _join_cells(r["cells"], delimiter)))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def indexed_text(header: Column, rows: Column, delimiter: str = "|") -> Column:
    """Delimited text with outer delimiters and a 1-based ``index`` column; no trailing break."""
    d = F.lit(delimiter)
    head = F.concat(d, F.lit("index"), d, _join_cells(header, delimiter), d)
    body = F.transform(rows, lambda r, i: F.concat(d, (i + 1).cast("string"), d,
                                                   _join_cells(r["cells"], delimiter), d))
    return F.array_join(F.concat(F.array(head), body), "\n")


#: a cell that reads as a number
NUMBER = r"^[+-]?(?:[0-9]+(?:[.][0-9]*)?|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$"


def markdown_columns(header: Column, rows: Column) -> Column:
    """The columns of a markdown table, a 0-based index first: ``array<struct<name, cells, number>>``. A column whose cells
    all read as numbers (empty ones aside) is a number column."""
    def column(j):
        cells = F.transform(rows, lambda r: F.coalesce(F.try_element_at(r["cells"], j), F.lit("")))
        return F.struct(F.element_at(header, j).alias("name"), cells.alias("cells"))

    index = F.struct(F.lit("").alias("name"), F.transform(rows, lambda r, i: i.cast("string")).alias("cells"))
    named = F.when(F.size(header) > 0, F.transform(F.sequence(F.lit(1), F.size(header)), column))
    cols = F.concat(F.array(index), F.coalesce(named, F.array().cast("array<struct<name:string,cells:array<string>>>")))
    return F.transform(cols, lambda c: F.struct(
        F.coalesce(c["name"], F.lit("")).alias("name"), c["cells"].alias("cells"),
        (F.exists(c["cells"], lambda x: x != "") & F.forall(c["cells"], lambda x: (x == "") | x.rlike(NUMBER))).alias("number")))


def markdown_aligned(cols: Column) -> Column:
    """:func:`markdown_columns` with decimal points under each other in number columns, and their widths: two more than the
    name at least."""
    def places(x):  # digits after the point; a cell without a point is one shorter still
        return F.when(F.instr(x, ".") > 0, F.length(x) - F.instr(x, ".")).otherwise(F.lit(-1))

    def measured(c):  # the most places of a column, once
        return F.struct(c["name"].alias("name"), c["cells"].alias("cells"), c["number"].alias("number"),
                        F.when(c["number"], F.array_max(F.transform(c["cells"], places))).alias("most"))

    def align(c):
        cells = F.when(c["number"], F.transform(c["cells"], lambda x: F.concat(x, F.repeat(F.lit(" "), c["most"] - places(x))))).otherwise(c["cells"])
        return F.struct(c["name"].alias("name"), cells.alias("cells"), c["number"].alias("number"))

    return F.transform(F.transform(F.transform(cols, measured), align), lambda c: F.struct(
        c["name"].alias("name"), c["cells"].alias("cells"), c["number"].alias("number"),
        F.greatest(F.length(c["name"]) + 2, F.coalesce(F.array_max(F.transform(c["cells"], F.length)), F.lit(0))).alias("width")))


def markdown_text(cols: Column, n_rows: Column) -> Column:
    """Markdown pipe table from :func:`markdown_aligned` columns: number columns to the right, others to the left, and an
    alignment row."""
    def put(x, c):
        return F.when(c["number"], F.lpad(x, c["width"], F.lit(" "))).otherwise(F.rpad(x, c["width"], F.lit(" ")))

    def line(cells):
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    dashes = lambda c: F.repeat(F.lit("-"), c["width"] + 1)
    ruler = F.transform(cols, lambda c: F.when(c["number"], F.concat(dashes(c), F.lit(":"))).otherwise(F.concat(F.lit(":"), dashes(c))))
    head = F.array(line(F.transform(cols, lambda c: put(c["name"], c))), F.concat(F.lit("|"), F.array_join(ruler, "|"), F.lit("|")))
    body = F.when(n_rows > 0, F.transform(F.sequence(F.lit(1), n_rows), lambda i: line(
        F.transform(cols, lambda c: put(F.element_at(c["cells"], i), c)))))
    return F.array_join(F.concat(head, F.coalesce(body, F.array().cast("array<string>"))), "\n")


def table_chunks(rows: DataFrame, mode: str = "plain", delimiter: str = "|", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """R1 for tables of any size: chunks (key, seq, head, n_lines, whole, text) of a table's lines in row order, ``head``
    being its header line (``plain`` or ``indexed``). Rows are numbered and joined by ranges, never gathered by table."""
    if mode == "plain":
        cells, header = _join_cells(F.col("cells"), delimiter), _join_cells(F.col("header"), delimiter)
        return text_chunks(rows, "table_id", ["row_idx"], cells, head=header, chunk_bytes=chunk_bytes)
    if mode != "indexed":
        raise ValueError(mode)
    return _line_texts(table_lines(rows, delimiter, chunk_bytes), mode, delimiter)


def table_lines(rows: DataFrame, delimiter: str = "|", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The lines of tables of any size, in row order (ties in row_idx: in that of header and cells), stored in chunks: the
    ``plain`` and the ``indexed`` texts are both made of them (:func:`digest_large_tables`)."""
    cells, header = _join_cells(F.col("cells"), delimiter), _join_cells(F.col("header"), delimiter)
    return stored_lines(rows.select("table_id", "row_idx", "header", "cells"), "table_id", ["row_idx"], ["header", "cells"], cells,
                        head=header, chunk_bytes=chunk_bytes)


def _line_texts(lines: DataFrame, mode: str, delimiter: str) -> DataFrame:
    d = F.lit(delimiter)
    if mode == "plain":
        return joined_lines(lines, lambda n, line: line)
    if mode != "indexed":
        raise ValueError(mode)
    t = joined_lines(lines, lambda n, line: F.concat(d, n.cast("string"), d, line, d))
    return t.withColumn("head", F.concat(d, F.lit("index"), d, "head", d))


def render_large_tables(rows: DataFrame, mode: str = "plain", delimiter: str = "|", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """R1 (``plain`` or ``indexed``) with tables of any number of rows: the texts of :func:`render_tables`, put together
    from ranges of lines."""
    t = whole_texts(table_chunks(rows, mode, delimiter, chunk_bytes))
    end = "\n" if mode == "plain" else ""
    return t.select(F.col("key").alias("table_id"), F.concat("head", F.lit("\n"), "text", F.lit(end)).alias("table"))


def digest_large_tables(lines: DataFrame, mode: str = "plain", delimiter: str = "|") -> DataFrame:
    """(table_id, chars, text_sha256) of the texts of :func:`render_large_tables`, from :func:`table_lines`: tables of any size,
    no text is put in one row."""
    t = text_digests(_line_texts(lines, mode, delimiter), start="\n", end="\n" if mode == "plain" else "")
    return t.withColumnRenamed("key", "table_id")


def render_tables(rows: DataFrame, mode: str = "plain", delimiter: str = "|") -> DataFrame:
    """One text per table (``plain``, ``indexed`` or ``markdown``), of every table. One collect per table: for tables
    within the size gate; :func:`render_large_tables` takes any."""
    g = _collected(rows)
    if mode == "plain":
        text = plain_text(F.col("header"), F.col("_rows"), delimiter)
    elif mode == "indexed":
        text = indexed_text(F.col("header"), F.col("_rows"), delimiter)
    elif mode == "markdown":
        g = g.select("table_id", F.size("_rows").alias("_n"), markdown_columns(F.col("header"), F.col("_rows")).alias("_c"))
        g = g.select("table_id", "_n", markdown_aligned(F.col("_c")).alias("_c"))
        text = markdown_text(F.col("_c"), F.col("_n"))
    else:
        raise ValueError(mode)
    return g.select("table_id", text.alias("table"))


# ---------------------------------------------------------------- R2 / R3: text -> rows


#: code points that no text holds (Unicode noncharacters): they stand for a delimiter and a line
#: break inside a quoted cell, and mark a cell that was quoted, while lines and cells are split
_DELIM, _LF, _CR, _QUOTED = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def _protect(text: Column, delimiter: str) -> Column:
    """Quoted cells (``"..."`` between delimiters or line ends, quotes doubled inside) with their
    delimiters, line breaks and quotes out of the way of the splits. The pattern has possessive
    repeats only, so cells of any length match without recursion."""
    d = "\\" + delimiter
    quoted = rf'(?<![^{d}\n])"([^"]*+(?:""[^"]*+)*+)"(?=[{d}\r\n]|$)'

    def hide(cell):
        for a, b in (('""', '"'), (delimiter, _DELIM), ("\n", _LF), ("\r", _CR)):
            cell = F.replace(cell, F.lit(a), F.lit(b))
        return F.concat(F.lit(_QUOTED), cell)

    hits = F.transform(F.regexp_extract_all(text, F.lit(quoted), F.lit(1)), hide)
    parts = F.zip_with(F.split(text, quoted, -1), hits, lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
    return F.when(text.contains('"'), F.array_join(parts, "")).otherwise(text)


def _restore(cell: Column, delimiter: str) -> Column:
    """The text of a cell: NULL for a missing-value word, else what :func:`_protect` hid put back."""
    out = cell
    for a, b in ((_DELIM, delimiter), (_LF, "\n"), (_CR, "\r"), (_QUOTED, "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(cell.startswith(_QUOTED), out).otherwise(cell)


def _parsed(df: DataFrame, text: str, keep: list[str], delimiter: str = "|") -> DataFrame:
    """Add ``header``, ``_body`` (rows of cells) and ``error`` for a delimited text column.

    One projection per step (lines, outer-delimiter test, cells, header/body): every
    intermediate array is computed once per row, never re-derived inside a lambda.
    """
    d = delimiter
    esc = "\\" + d if not d.isalnum() else d
    x = df.select(*keep, F.split(_protect(strip_ws(F.col(text)), d), "\r?\n").alias("_all"))
    # every line (blank ones included) must carry the outer delimiters
    x = x.select(*keep, F.filter("_all", lambda ln: ln != "").alias("_lines"),
                 F.forall("_all", lambda ln: ln.startswith(d) & ln.endswith(d)).alias("_outer"))
    x = x.select(*keep, F.transform("_lines", lambda ln: F.when(F.col("_outer"), ln.substr(
        F.lit(2), F.length(ln) - F.lit(2))).otherwise(ln)).alias("_lines"))
    x = x.select(*keep, F.transform("_lines", lambda ln: F.transform(
        F.split(ln, esc, -1), lambda c: _restore(c, d))).alias("_cells"))
    x = x.select(*keep, F.element_at("_cells", 1).alias("header"),
                 F.slice("_cells", 2, F.greatest(F.size("_cells") - 1, F.lit(0))).alias("_body"))
    return x.withColumn("error", F.when(F.exists("_body", lambda r: F.size(r) > F.size("header")),
                                        F.lit("row longer than header")))


def _value(cell: Column) -> Column:
    """A body cell: missing-value words read as NULL."""
    return F.when(cell.isin(MISSING_WORDS), None).otherwise(cell)


def record_cells(record: Column, delimiter: str) -> Column:
    """The cells of one delimited record: delimiters and line breaks inside double quotes do not split."""
    esc = "\\" + delimiter if not delimiter.isalnum() else delimiter
    return F.transform(F.split(_protect(record, delimiter), esc, -1), lambda c: _restore(c, delimiter))


def parse_records(records: DataFrame, delimiter: str, key: str = "table_id") -> DataFrame:
    """Records (key, row_idx, header_text, text, closed) of delimited files to table form: as :func:`parse_tables`, but
    row by row, so a table may be of any size. ``error`` marks a row longer than its header, or of a record whose
    quote stays open (no cells)."""
    x = records.select(key, "row_idx", "closed", record_cells(F.col("header_text"), delimiter).alias("header"),
                       record_cells(F.col("text"), delimiter).alias("_row"))
    error = (F.when(~F.col("closed"), F.lit("open quote"))
             .when(F.size("_row") > F.size("header"), F.lit("row longer than header")))
    padded = F.transform(F.sequence(F.lit(1), F.size("header")), lambda j: _value(F.try_element_at(F.col("_row"), j)))
    return x.select(key, "row_idx", "header", F.when(error.isNull(), padded).alias("cells"), error.alias("error"))


def parse_tables(texts: DataFrame, text: str = "table", key: str = "table_id", delimiter: str = "|") -> DataFrame:
    """R2 + F8: delimited text back to table form.

    If every line (after trimming the text) starts and ends with the delimiter,
    exactly one delimiter is removed from each end of each line. Blank lines are
    skipped, the first line is the header, delimiters and line breaks inside double quotes do
    not split and quoted cells are unquoted (as R1 writes them), short rows are padded with
    NULL, and empty cells and missing-value words (``NA``, ``null``, ..) read as NULL. A row longer than the header rejects the table: it yields one
    row with ``error`` set and no cells (filter ``error IS NOT NULL`` to report them).
    """
    p = _parsed(texts, text, [key], delimiter)
    ex = p.select(key, "header", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("_body")))
                  .alias("_pos", "_row"))
    ncol = F.size("header")
    padded = F.transform(F.sequence(F.lit(1), ncol),
                         lambda j: _value(F.try_element_at(F.col("_row"), j)))
    return ex.select(key, (F.col("_pos") + 1).cast("int").alias("row_idx"), "header",
                     F.when(F.col("_row").isNotNull(), padded).alias("cells"), "error")


def parse_markdown_tables(texts: DataFrame, text: str = "table", key: str = "table_id") -> DataFrame:
    """Markdown grid to table form; ruler and alignment lines ``^[+-|=: ]+$`` are dropped, the
    first and last pipe-split pieces are discarded and cells are trimmed."""
    lines = F.filter(F.split(F.col(text), "\r?\n"), lambda ln: ~ln.rlike(r"^[+\-|=: ]+$"))
    pieces = F.transform(lines, lambda ln: F.split(ln, "\\|", -1))
    split = F.transform(pieces, lambda p: F.transform(
        F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), lambda c: strip_ws(c)))
    p = texts.select(key, split.alias("_s"))
    p = p.select(key, F.element_at("_s", 1).alias("header"),
                 F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))).alias("_body"))
    # outer generator: an inner one makes the optimizer infer ``size(_body) > 0`` and push
    # it below the projections, re-evaluating the whole text expression in a Filter
    ex = p.select(key, "header", F.posexplode_outer("_body").alias("_pos", "cells")).where(F.col("_pos").isNotNull())
    return ex.select(key, (F.col("_pos") + 1).cast("int").alias("row_idx"), "header", "cells")


def to_long(tables: DataFrame, key: str = "table_id") -> DataFrame:
    """Table form to one row per cell ``(key, row_idx, col_idx, column_name, value)``."""
    z = tables.select(
        key, "row_idx", F.posexplode_outer(F.arrays_zip(F.col("header").alias("h"), F.col("cells").alias("v")))
        .alias("_j", "_z")).where(F.col("_j").isNotNull())
    return z.select(key, "row_idx", (F.col("_j") + 1).cast("int").alias("col_idx"),
                    F.col("_z.h").alias("column_name"), F.col("_z.v").alias("value"))


# ---------------------------------------------------------------- documents per table


def row_document(header: Column, cells: Column) -> Column:
    """Offline stand-in for a generated row document: ``col: value; ...``."""
    return F.array_join(F.transform(header, lambda h, i: F.concat(
        h, F.lit(": "), F.coalesce(F.try_element_at(cells, i + 1), F.lit("")))), "; ")


def table_examples(rows: DataFrame, seed: int = DOC_RANDOM_SEED, shuffle: bool = False) -> DataFrame:
    """Indexed table text and its assembled document set, from one collect per table.

    A12: documents are numbered in row order, ``Document i: text``, joined by a blank line.
    With ``shuffle`` (W5) they come in the order of a seeded hash per table (stable,
    independent of partitioning).
    """
    first = [seeded_hash(seed, "table_id", "row_idx").alias("_h")] if shuffle else []
    docs = F.array_sort(F.collect_list(F.struct(*first, F.col("row_idx"),
                                                row_document(F.col("header"), F.col("cells")).alias("doc"))))
    g = _collected(rows, {"_docs": docs})
    doc_set = F.array_join(F.transform("_docs", lambda x, i: F.concat(
        F.lit("Document "), (i + 1).cast("string"), F.lit(": "), x["doc"])), "\n\n")
    return g.select("table_id", indexed_text(F.col("header"), F.col("_rows")).alias("table"),
                    doc_set.alias("documents"))


def shuffle_positions(rows: DataFrame, seed: int = DOC_RANDOM_SEED) -> DataFrame:
    """Per table, the shuffled position of each original row (both 1-based)."""
    h = seeded_hash(seed, "table_id", "row_idx")
    w = Window.partitionBy("table_id").orderBy(h, "row_idx")  # sorted, never collected
    return rows.select("table_id", F.row_number().over(w).alias("position"), "row_idx")


def document_prompts(tables: DataFrame, template: str, seed: int = DOC_RANDOM_SEED,
                     description: Column | None = None, question: Column | None = None,
                     answer: Column | None = None) -> DataFrame:
    """R4 + W7 + X8: one generation prompt per table row (``doc_row`` 1-based) with a
    hash-drawn document length 1..5."""
    from quire.functions.text import fill_template

    lines = F.split(strip_ws(F.col("table")), "\n")
    n = F.size(F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda ln: ln != ""))
    # outer generator + filter on its output: an inner one (or a filter on ``n``) would be
    # pushed below the projections and re-render the table text
    ex = tables.select("*", F.explode_outer(F.when(n > 0, F.sequence(F.lit(1), n))).alias("doc_row"))
    ex = ex.where(F.col("doc_row").isNotNull())
    doc_len = hash_choice(seeded_hash(seed, "table", "doc_row"), 1, 5)
    prompt = fill_template(template, table=F.col("table"), doc_row=F.col("doc_row"), doc_len=doc_len,
                           description=description if description is not None else F.lit(""),
                           question=question if question is not None else F.lit(""),
                           answer=answer if answer is not None else F.lit(""))
    return ex.select("table_id", F.col("doc_row").cast("int").alias("doc_row"), doc_len.cast("int").alias("doc_len"),
                     prompt.alias("prompt"))


def table_profile(ex: DataFrame, key: str = "table_id", table: str = "table",
                  documents: str = "documents") -> DataFrame:
    """A10 + F8: rows, columns (index excluded), table tokens, document tokens, document
    tokens per row; a table that does not parse keeps its row with ``error`` set and NULL
    metrics (filter ``error IS NULL`` to leave it out).

    Computed per row of ``ex`` from the parsed arrays: no explode, no shuffle. No filter
    is applied here on purpose: a filter on a parse result would be pushed below the
    projections and re-evaluate the text expression feeding it.
    """
    t = ex.select(key, table, token_count(table).alias("_tt"), token_count(documents).alias("_dt"))
    p = _parsed(t, table, [key, "_tt", "_dt"])
    ok = F.col("_tt").isNotNull() & F.col("error").isNull() & (F.coalesce(F.size("_body"), F.lit(0)) > 0)
    # columns without any value are left out; the index column is not counted
    filled = F.size(F.filter(F.sequence(F.lit(1), F.size("header")), lambda j: F.exists(
        "_body", lambda r: F.coalesce(_value(F.try_element_at(r, j)), F.lit("")) != "")))
    err = (F.when(F.col("_tt").isNull(), F.lit("no table")).when(F.col("error").isNotNull(), F.col("error"))
           .when(F.coalesce(F.size("_body"), F.lit(0)) <= 0, F.lit("no rows")))
    return p.select(key, F.when(ok, F.size("_body")).cast("bigint").alias("num_rows"),
                    F.when(ok, filled - 1).cast("bigint").alias("num_cols"),
                    F.when(ok, F.col("_tt")).cast("bigint").alias("num_tab_tokens"),
                    F.when(ok, F.col("_dt")).cast("bigint").alias("num_doc_tokens"),
                    F.when(ok, F.round(F.col("_dt") / F.size("_body"), 6)).alias("avg_doc_tokens"),
                    err.alias("error"))
