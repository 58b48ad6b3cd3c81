"""Features of texts and of changes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that never become tags, in any case.
STOP_WORDS = (
    "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "return", "goto", "sizeof", "typedef", "struct", "union", "enum",
    "const", "static", "extern", "inline", "volatile", "void", "int", "char", "float", "double", "long", "short", "unsigned", "signed", "size_t",
    "ssize_t", "ptrdiff_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "int8_t", "int16_t", "int32_t", "int64_t", "null", "true", "false",
    "include", "define", "ifdef", "ifndef", "endif", "pragma", "stdio", "stdlib", "string", "unistd", "errno", "echo", "exit", "then", "fi", "done",
    "esac", "local", "export", "set", "unset", "shift", "function", "def", "class", "import", "from", "with", "try", "except", "finally", "raise",
    "yield", "lambda", "pass", "del", "and", "or", "not", "none", "self", "the", "this", "that", "main", "bool", "byte", "bytes", "bits", "bit",
    "param", "params", "args", "argc", "argv", "ret", "buf", "buff", "buffer", "ptr", "len", "size", "sized", "tmp", "temp", "retval", "val", "var",
    "vars", "vec", "str", "msg", "ctx", "cfg", "src", "dst", "num", "idx", "obj", "objs", "elem", "info", "init", "func", "new", "old", "get", "put",
    "add", "end", "cur", "max", "min", "sum", "avg", "total", "count", "file", "files", "path", "paths", "line", "lines", "row", "code", "data",
    "text", "type", "types", "name", "names", "left", "right", "first", "second", "last", "next", "prev", "todo", "fixme", "note", "notes", "using",
    "namespace", "public", "private",
)
TAGS, DISTINCT, SHORTEST, LONGEST, SAMPLE = 4, 256, 3, 40, 8192


def line_count(text: Column) -> Column:
    """A11."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n"), 0).otherwise(1))


def lines(text: Column) -> Column:
    """Without their ends; none of an empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def _matching(a: Column, b: Column) -> Column:
    """Leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def _range(n_old: Column, n_new: Column, head: Column, back: Column) -> Column:
    """From the sizes of both and the lines that their beginnings and their ends share."""
    tail = F.least(back, F.least(n_old, n_new) - head)
    same = (head == n_old) & (head == n_new)
    first = F.when(same, 1).otherwise(head + 1)
    return F.struct(first.alias("first"), F.when(same, 1).otherwise(F.greatest(n_new - tail, first)).alias("last"))


def changed_range(old: Column, new: Column) -> Column:
    """(first, last) changed line of the new text, from 1; 1 to 1 if no line differs."""
    a, b = lines(old), lines(new)
    return _range(F.size(a), F.size(b), _matching(a, b), _matching(F.reverse(a), F.reverse(b)))


def _fitting(own: Column) -> Column:
    """Whole lines of an array, as many as fit the sample, as one text."""
    step = lambda acc, x: F.struct((acc["size"] + F.octet_length(x) + 1).alias("size"), F.when(acc["size"] + F.octet_length(x) + 1 <= SAMPLE, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))
    return F.aggregate(own, F.struct(F.lit(0).alias("size"), F.array().cast("array<string>").alias("kept")), step, lambda acc: F.array_join(acc["kept"], "\n"))


def changed_lines(old: Column, new: Column) -> Column:
    """Whole lines of the range, as many as fit the sample."""
    r = changed_range(old, new)
    return _fitting(F.slice(lines(new), r["first"], r["last"] - r["first"] + 1))


def tokens(text: Column) -> Column:
    """Identifiers in lower case, without stop words and garbage."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda w: F.lower(w))
    digits = lambda w: F.length(F.regexp_replace(w, "[^0-9]", ""))
    keep = lambda w: F.length(w).between(SHORTEST, LONGEST) & ~w.isin(*STOP_WORDS) & ~((F.length(w) > 6) & ~w.rlike("[aeiou]")) & ~((F.length(w) > 4) & (digits(w) * 5 > F.length(w) * 2))
    return F.filter(found, keep)


def top_tags(words: Column, most: int = TAGS) -> Column:
    """The most frequent of an array's first 256 distinct tokens, ties in order
    of the alphabet. Equal tokens stand together once sorted, so counting is one pass
    over them."""
    return _counted(words, F.slice(F.array_distinct(words), 1, DISTINCT), most)


def _counted(words: Column, known: Column, most: int) -> Column:
    # what is known goes through the fold: within the lambda it would be computed for each word
    start = F.struct(known.alias("known"), F.lit("").alias("word"), F.lit(0).alias("n"), F.array().cast("array<struct<n:int,word:string>>").alias("out"))
    done = lambda acc: F.when(acc["n"] == 0, acc["out"]).otherwise(F.array_append(acc["out"], F.struct((-acc["n"]).alias("n"), acc["word"].alias("word"))))

    def step(acc: Column, w: Column) -> Column:
        same = w == acc["word"]
        counted = F.struct(acc["known"].alias("known"), w.alias("word"), F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when(same, acc["out"]).otherwise(done(acc)).alias("out"))
        # with fewer than all that may be known, every word is
        return F.when((F.size(acc["known"]) < DISTINCT) | F.array_contains(acc["known"], w), counted).otherwise(acc)

    counted = F.aggregate(F.sort_array(words), start, step, done)
    return F.array_join(F.transform(F.slice(F.sort_array(counted), 1, most), lambda c: F.concat(F.lit("#"), c["word"])), " ")


def is_binary(content: Column) -> Column:
    """X23, of a binary column: byte classes of the first bytes."""
    head = F.decode(F.substring(content, 1, SAMPLE), "ISO-8859-1")
    n = F.length(head)
    count = lambda classes: F.regexp_count(head, F.lit(classes))
    return (n > 0) & ((count(r"\x00") > 0) | (count(r"[\x01-\x08\x0B\x0C\x0E-\x1F]") > F.floor(n / 10)) | (count(r"[\x7F-\xFF]") > F.floor(n / 3)))


def described(changes: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Adds what a change says: range (first, last), lines, and their tags (of
    the old text where the new one is empty; none of binary content). Step by step, as
    columns, so that nothing is computed twice."""
    kept = changes.columns
    rows = changes.withColumns({"_old": lines(F.col(old)), "_new": lines(F.col(new))})
    rows = rows.withColumns({"_head": _matching(F.col("_old"), F.col("_new")), "_back": _matching(F.reverse("_old"), F.reverse("_new"))})
    rows = rows.withColumn("range", _range(F.size("_old"), F.size("_new"), F.col("_head"), F.col("_back")))
    rows = rows.withColumn("lines", _fitting(F.slice("_new", F.col("range.first"), F.col("range.last") - F.col("range.first") + 1)))
    rows = rows.withColumn("_said", F.when(is_binary(F.col(old).cast("binary")) | is_binary(F.col(new).cast("binary")), "").when(F.length(new) > 0, F.col("lines")).otherwise(F.substring(old, 1, SAMPLE)))
    rows = rows.withColumn("_words", tokens(F.col("_said"))).withColumn("_known", F.slice(F.array_distinct("_words"), 1, DISTINCT))
    return rows.withColumn("tags", _counted(F.col("_words"), F.col("_known"), TAGS)).select(*kept, "range", "lines", "tags")


def summary(old: Column, new: Column, tags: Column, changed: Column | None = None) -> Column:
    """Net change of lines, range (``changed``, if it is known), bytes, tags."""
    net = line_count(new) - line_count(old)
    r = changed_range(old, new) if changed is None else changed
    where = F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string")))
    head = F.format_string("+%d/-%d lines %s delta=%d file=%d", F.greatest(net, F.lit(0)), F.greatest(-net, F.lit(0)), where, F.octet_length(new) - F.octet_length(old), F.octet_length(new))
    return F.when(F.length(tags) > 0, F.concat_ws(" ", head, tags)).otherwise(head)


def create_summary(content: Column, tags: Column) -> Column:
    """X26."""
    head = F.format_string("CREATE (%d B)", F.octet_length(content))
    return F.when(F.length(tags) > 0, F.concat_ws(" ", head, tags)).otherwise(head)


#: Tags that only binary content gives.
BINARY_TAGS = ("#GNU", "#ELF", "#AWAV")


def hides_binary(summary: Column) -> Column:
    """null where a summary holds such a tag."""
    return F.when(~summary.rlike("|".join(BINARY_TAGS)), summary)
