"""A code base made from the tables: one source file for each part, customer, supplier and nation.

The texts hang on the rows' values: which module a file imports and calls, what it queries, whether it has routes, nested
functions, errors or annotations. They are written by expressions that Spark and DuckDB read alike, so both see the same bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import table

# Names in double brackets stand for columns of the row; a line that begins with ?n? or !n? is there only if size % n is 0, or isn't.
PYTHON = """# Keeps [[label]] in order
import logging
from app.m[[a_dir]].part_[[a]] import load_[[a]]
from app.m[[b_dir]].part_[[b]] import save_[[b]]


?4?@Service
class Part[[k]]Service(BaseService):
    def find_[[k]](self, key, limit=10):
        if key is None:
            raise Missing[[kind]]Error("no key")
        rows = load_[[a]](key)
        return self.rank_[[k]](rows)

?3?    def rank_[[k]](self, rows: list):
?3?        def order_[[k]](row):
?3?            return row.size
?3?        return sorted(rows, key=order_[[k]])
!3?    async def rank_[[k]](self, *rows):
!3?        return await self.find_[[k]](rows)

if DEBUG:
    def trace_[[k]](text):
        logging.info(text)

?2?@app.get("/api/parts[[s]]/[[k]]")
?2?# reads one [[kind]]
?2?async def read_[[k]](request, key: int = 0):
?2?    return load_[[k]](request.key)
!2?@router.post("/api/parts/{id}/part[[k]]/")
!2?def write_[[k]](request):
!2?    db.[[kind]]_events.insert_one(request)
!2?    return save_[[k]](request)

def load_[[k]](key):
    sql = "SELECT * FROM [[kind]]_[[t]] JOIN stock_[[s]] ON a = b"
    db.[[kind]]_events.find(key)
    return save_[[b]](run(sql))

def save_[[k]](rows):
?5?    run("CREATE TABLE IF NOT EXISTS [[kind]]_[[t]] (id INT)")
    run("INSERT INTO [[kind]]_[[t]] SELECT * FROM staging_[[s]]")
    return load_[[a]](rows)
"""
TSX = """import { useState } from "react";
import { View[[a]] } from "../c[[a_dir]]/View[[a]]";

?3?export function useRows[[k]](size) {
?3?  return useState(size);
?3?}

export function View[[k]](props) {
  const [rows, setRows] = useState([]);
  const more = useRows[[b]]([[s]]);
?2?  useEffect(() => {
?2?    fetch("/api/parts[[bs]]/[[b]]/rows?page=1");
?2?  });
  function draw[[k]](row) {
    return <View[[a]] row={row} />;
  }
!3?  axios.get("/api/parts/{id}/part[[b]]");
!5?  axios.get("/api/parts[[s]]");
  return <List[[s]] items={rows} draw={draw[[k]]} />;
}

export class Panel[[k]] extends React.Component {
?3?  async load(key, size) {
?3?    axios.post("/lost/[[t]]", key);
?3?    throw new Lost[[kind]]Error(key);
?3?  }
  render() {
    return <View[[k]] />;
  }
}
"""
JAVA = """package shop.s[[a_dir]];
import shop.s[[a_dir]].Store[[a]];

?2?@Repository
!2?@RestController
public class Store[[k]] extends Store[[a]] implements Closeable, Named[[s]] {
  private Store[[b]] next;
  public void save(Order order, int size) {
    if (size > [[t]]) {
      throw new Full[[kind]]Exception(order);
    }
    next.save(order);
  }
}
"""
SQL = """CREATE TABLE IF NOT EXISTS [[kind]]_[[k]] (
  id BIGINT,
  [[kind]]_id INT,
  price DECIMAL(10, [[s]]),
  created_at TIMESTAMP
);
INSERT INTO [[kind]]_[[k]] SELECT * FROM staging_[[s]];
?2?CREATE VIEW view_[[k]] AS SELECT id, count(price) FROM [[kind]]_[[k]] JOIN stock_[[s]] ON id = id;
UPDATE stock_[[s]] SET n = 0;
"""


def _expression(template: str, columns: dict[str, str]) -> str:
    """A text with columns in brackets as an SQL expression."""
    out = []
    for at, piece in enumerate(template.split("[[")):
        name, _, rest = piece.partition("]]") if at else ("", "", piece)
        if at:
            out.append(f"CAST({columns[name]} AS STRING)")
        if rest:
            out.append(f"'{rest}'")
    return "concat(" + ", ".join(out or ["''"]) + ")"


def _text(template: str, columns: dict[str, str]) -> str:
    """A template's lines, those with a mark in a CASE on the row's size."""
    out = []
    for line in template.splitlines(keepends=True):
        if line[0] in "?!" and line[2:3] == "?":
            sign = "=" if line[0] == "?" else "<>"
            out.append(f"CASE WHEN {columns['size']} % {line[1]} {sign} 0 THEN {_expression(line[3:], columns)} ELSE '' END")
        elif out and not out[-1].startswith("CASE"):
            out[-1] = out[-1] + "\0" + line
        else:
            out.append(line)
    whole = [x if x.startswith("CASE") else _expression(x.replace("\0", ""), columns) for x in out]
    return "concat(" + ", ".join(whole) + ")"


def _file(source: str, key: str, size: str, kind: str, label: str, path: str, language: str, template: str, dirs: int, hub: int) -> tuple[str, str, str, str, str]:
    near = f"CASE WHEN {key} < {size} THEN {key} + {size} ELSE {key} - {size} END"  # a step back, or forward for the first rows: loops and long paths
    columns = {
        "k": key, "size": size, "kind": f"lower({kind})", "label": label, "a": f"({near})", "b": f"{key} % {hub}", "a_dir": f"({near}) % {dirs}", "b_dir": f"{key} % {hub} % {dirs}",
        "t": f"{key} % 31", "s": f"{key} % 7", "bs": f"{key} % {hub} % 7", "dir": f"{key} % {dirs}",
    }
    return source, key, _expression(path, columns), language, _text(template, columns)


FILES = [
    _file("part", "p_partkey", "p_size", "p_type", "p_name", "app/m[[dir]]/part_[[k]].py", "python", PYTHON, 40, 97),
    _file("customer", "c_custkey", "(c_nationkey + 1)", "c_mktsegment", "c_name", "web/c[[dir]]/View[[k]].tsx", "typescript", TSX, 60, 41),
    _file("supplier", "s_suppkey", "(s_nationkey + 1)", "'supply'", "s_name", "java/s[[dir]]/Store[[k]].java", "java", JAVA, 9, 5),
    _file("nation", "n_nationkey", "(n_regionkey + 1)", "n_name", "n_name", "sql/n[[k]].sql", "sql", SQL, 5, 5),
]


#: Rows of a table, and so source files, for one task.
FILES_A_TASK = 4000


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows over as many tasks as their number asks for; the count reads the files' footers."""
    return rows.repartition(-(-rows.count() // FILES_A_TASK) or 1, key)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, text.

    The tables are small for the texts that come from them, so their rows are dealt out before they become texts: one task would write all of a table.
    """
    parts = [_dealt(table(spark, sf_dir, t), key).select(F.expr(path).alias("path"), F.lit(language).alias("language"), F.expr(text).alias("text")) for t, key, path, language, text in FILES]
    return reduce(DataFrame.unionByName, parts)


#: The same in DuckDB, as the beginning of a WITH clause.
FILES_SQL = "f AS (" + " UNION ALL ".join(f"SELECT {path} AS path, '{language}' AS language, {text} AS text FROM {t}" for t, _, path, language, text in FILES) + ")"
