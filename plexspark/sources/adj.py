"""Adjacency files: ``AdjacencyGraph`` or ``WeightedAdjacencyGraph``, n, m, n offsets, m ends, m weights.

Words are told apart by blanks, wherever lines break, so the place of a word in
the whole file gives its meaning. Files are read in ranges of bytes
(``sources.words``), words counted per range and counts summed over ranges; no
file passes through one task, however its words are laid out on lines. From
stores that only Spark's readers open, they come by rows of text, which end at
line feeds or spaces, whichever the first bytes of the first file have: there a
file whose lines are short at first and very long later makes long rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexspark.functions import edges as rules
from plexspark.functions.order import numbered
from plexspark.graph import Graph
from plexspark.plans.lineage import cut
from plexspark.sources import words as ranges

PLAIN, WEIGHTED = "AdjacencyGraph", "WeightedAdjacencyGraph"


#: Bytes at the start of a file that tell how long its lines are, and a length beyond which rows end at spaces instead.
HEAD, LINE = 1 << 16, 1 << 12


def separator(spark: SparkSession, path: str) -> str:
    """What ends a row, so that rows are short: a line feed, or a space where lines are long. Looks at the first bytes of the first file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(where)
    if not found:
        raise FileNotFoundError(path)
    files = [g for f in found for g in (store.listStatus(f.getPath()) if f.isDirectory() else [f])]
    files = sorted((f for f in files if f.getLen() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getPath().toString())
    if not files:
        return "\n"
    stream = store.open(files[0].getPath())
    try:
        head = bytes(jvm.org.apache.commons.io.IOUtils.readFully(stream, min(files[0].getLen(), HEAD)))
    finally:
        stream.close()
    return "\n" if max(map(len, head.split(b"\n"))) < LINE else " "


def words(spark: SparkSession, path: str, size: int = ranges.RANGE) -> DataFrame:
    """(place, word) of a text file or a folder of part files, places counted from 0; ``size``: bytes of a range."""
    if not ranges.readable(path):
        return _rows(spark, path)
    ranges.files(path)  # fails here if there is none
    ranges.register(spark)
    found = cut(spark.read.format("blank_words").option("path", path).option("range", str(size)).load())
    sizes = found.groupBy("block").agg(F.count("*").alias("size"))
    before = cut(sizes.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))  # one row a range
    return found.join(F.broadcast(before), "block").select((F.col("before") + F.col("i")).alias("place"), "word")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(place, word) by rows of text."""
    lines = spark.read.text(path, lineSep=separator(spark, path)).select(F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.split("value", r"[ \t\r\n\x00]+").alias("w"))
    lines = cut(lines.select("block", "line", F.filter("w", lambda x: x != "").alias("w")).where(F.size("w") > 0))
    sizes = lines.groupBy("block").agg(F.sum(F.size("w")).alias("size"))
    before = sizes.select("block", F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a block
    within = F.coalesce(F.sum(F.size("w")).over(Window.partitionBy("block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("within", within).join(before, "block")
    return cut(placed.select(F.posexplode("w").alias("i", "word"), "within", "before").select((F.col("before") + F.col("within") + F.col("i")).alias("place"), "word"))


def read_adj(spark: SparkSession, path: str, weighted: bool | None = None, symmetric: bool = True, drop_self_loops: bool | None = None) -> Graph:
    """The graph of an adjacency file; vertices are 0 to n - 1.

    ``weighted`` None takes what the file has; True gives weight 1 where it has
    none, False drops weights. ``symmetric`` adds the reverse of every edge.
    """
    return graph_of(spark, path, words(spark, path), weighted, symmetric, drop_self_loops)


def graph_of(spark: SparkSession, path: str, found: DataFrame, weighted: bool | None = None, symmetric: bool = True, drop_self_loops: bool | None = None) -> Graph:
    """The graph of the words (place, word) of an adjacency file, which are read several times; ``path`` is named in errors."""
    tokens = found
    head = {r.place: r.word for r in tokens.where("place < 3").collect()}
    if head.get(0) not in (PLAIN, WEIGHTED):
        raise ValueError(f"{path}: the first word must be {PLAIN} or {WEIGHTED}")
    try:
        n, m = int(head[1]), int(head[2])
    except (KeyError, ValueError):
        raise ValueError(f"{path}: the header needs two numbers") from None
    own = head[0] == WEIGHTED
    if n <= 0 or m <= 0:
        raise ValueError(f"{path}: a graph needs vertices and edges")
    numbers = tokens.where("place >= 3").select((F.col("place") - 3).alias("place"), F.col("word").try_cast("long").alias("x"))
    seen = numbers.agg(F.count("*").alias("words"), F.count("x").alias("numbers")).first()
    if seen["words"] != n + (2 if own else 1) * m:
        raise ValueError(f"{path}: {n} vertices and {m} edges do not agree with the number of words")
    if seen["numbers"] != seen["words"]:
        raise ValueError(f"{path}: a word is not a number")
    offsets = numbers.where(F.col("place") < n).select(F.col("place").alias("src"), F.col("x").alias("start"))
    nexts = offsets.select((F.col("src") - 1).alias("src"), F.col("start").alias("stop"))
    spans = offsets.join(nexts, "src", "left").select("src", "start", F.coalesce("stop", F.lit(m)).alias("stop"))
    if not spans.where(f"start > stop OR start < 0 OR stop > {m}").isEmpty():
        raise ValueError(f"{path}: offsets must ascend")
    tails = spans.where("start < stop").select("src", F.explode(F.sequence("start", F.col("stop") - 1)).alias("j"))
    heads = numbers.where((F.col("place") >= n) & (F.col("place") < n + m)).select((F.col("place") - n).alias("j"), F.col("x").alias("dst"))
    first = spans.agg(F.min("start")).first()[0]  # what lies before belongs to no vertex
    if not heads.where((F.col("j") >= first) & ((F.col("dst") < 0) | (F.col("dst") >= n))).isEmpty():
        raise ValueError(f"{path}: an edge ends outside the graph")
    edges = tails.join(heads, "j")
    if own if weighted is None else weighted:
        if own:
            weights = numbers.where(F.col("place") >= n + m).select((F.col("place") - n - m).alias("j"), F.col("x").cast("int").alias("weight"))
            edges = edges.join(weights, "j").select("src", "dst", "weight")
        else:
            edges = edges.select("src", "dst", F.lit(1).alias("weight"))
    else:
        edges = edges.select("src", "dst")
    return Graph.from_edges(edges, n, directed=not symmetric, drop_self_loops=drop_self_loops)


def adj_offsets(g: Graph) -> DataFrame:
    """(id, start): where each vertex's edges begin when edges are sorted by src and dst."""
    own = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    every = numbered(g.vertices.join(own, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d")), "id")
    # The edges of all vertices before: totals of blocks of ids, then within a block.
    block = every.withColumn("block", F.expr("j div 65536"))
    sums = block.groupBy("block").agg(F.sum("d").alias("s"))
    before = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a block of ids
    inside = F.coalesce(F.sum("d").over(Window.partitionBy("block").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block.withColumn("inside", inside).join(before, "block").select("id", (F.col("before") + F.col("inside")).alias("start"))


def write_adj(g: Graph, path: str, one_file: bool = False) -> None:
    """The graph as an adjacency file: a folder of part files in order, a word a line."""
    n, m = g.num_nodes(), g.num_edges()
    first = g.vertices.agg(F.min("id"), F.max("id")).first()
    if n and (first[0], first[1]) != (0, n - 1):
        raise ValueError("vertices must be 0 to n - 1")
    kind = WEIGHTED if g.weighted else PLAIN
    ends = ["dst", *(["weight"] if g.weighted else [])]
    word = lambda c: F.col(c).cast("string").alias("word")
    head = g.spark.range(1, numPartitions=1).select(F.posexplode(F.array(*map(F.lit, [kind, str(n), str(m)]))).alias("id", "word"))
    if one_file:
        keyed = lambda df, part, a, b, w: df.select(F.lit(part).alias("part"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), w)
        parts = [keyed(head, 0, "id", "id", F.col("word")), keyed(adj_offsets(g), 1, "id", "id", word("start")), *(keyed(g.edges, 2 + i, "src", "dst", word(c)) for i, c in enumerate(ends))]
        out = functools.reduce(DataFrame.union, parts).repartition(1).sortWithinPartitions("part", "a", "b").select("word")
    else:  # parts are sorted each for itself and written one after the other, so words need no places
        ordered = lambda df, *by: df.repartitionByRange(*by).sortWithinPartitions(*by)
        out = functools.reduce(DataFrame.union, [head.select("word"), ordered(adj_offsets(g), "id").select(word("start")), *(ordered(g.edges, "src", "dst").select(word(c)) for c in ends)])
    out.write.mode("overwrite").text(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, line) of what ``write_values`` or ``write_embedding`` wrote: the i-th line is that of vertex i."""
    rows = cut(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")))
    return numbered(rows, "file", "block", "n").select(F.col("j").alias("id"), F.col("value").alias("line"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): the i-th word is the label of vertex i, below 0 if unknown."""
    out = words(spark, path).select(F.col("place").alias("id"), F.col("word").try_cast("int").alias("label"))
    if not out.where("label IS NULL").isEmpty():
        raise ValueError(f"{path}: a label is not a number")
    return out


def _lines(df: DataFrame, line, path: str, one_file: bool) -> None:
    out = df.select("id", line.alias("value"))
    out = out.repartitionByRange(1, "id") if one_file else out.repartitionByRange("id")
    out.sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)


def write_values(df: DataFrame, path: str, column: str | None = None, one_file: bool = False) -> None:
    """A value a line by id; doubles with six significant digits."""
    column = column or next(c for c in df.columns if c != "id")
    floating = dict(df.dtypes)[column] in ("double", "float")
    _lines(df, rules.significant(F.col(column)) if floating else F.col(column).cast("string"), path, one_file)


def write_embedding(cells: DataFrame, path: str, one_file: bool = False) -> None:
    """A vertex a line by id, its values by cluster with six decimals."""
    from plexspark.plans.embedding import wide

    _lines(wide(cells), rules.decimals(F.col("embedding")), path, one_file)
