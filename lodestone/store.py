"""The document store: one collection, by id and by search."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import DocumentNotFound, InvalidDocument, InvalidSize
from lodestone.operators import op_log
from lodestone.operators.postings import Index, Layered, Scan
from lodestone.operators.search import search
from lodestone.schema import DEFAULT_SIZE, LARGEST_SIZE, LOG_ROWS, OP_LOG
from lodestone.session import setting
from lodestone.sources import corpus, index_files


class DocumentStore:
    """A collection in a folder that the cluster shares.

    ``log/`` has the writes (a folder for each append), ``claims/`` an empty file
    for each number that a write has taken.  ``state-<seq>/`` has one row for
    each id, compacted from the log, and the names of the appends that are in
    it; ``index-<seq>/`` is the index of that state, and the folders ``tail-...``
    in it are indexes of what has been written since.

    Reads see all writes at once.  Several processes may write: a number is
    taken by making a file that must not exist yet, and where numbers are equal
    all the same (streams bring their own) the append's name decides.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, name: str = "documents"):
        self.spark = spark
        self.path = f"{path or setting('path', 'lodestone-data', spark)}/{name}"

    # the collection

    def _at(self, name: str) -> tuple:
        """The file system and a path below the collection's."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str = "") -> list[str]:
        fs, path = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _there(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def _drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._at(name)
            fs.delete(path, True)

    def exists(self) -> bool:
        return self._there("log")

    def create_index_if_needed(self) -> bool:
        """Make the collection unless it is there; whether it was made."""
        if self.exists():
            return False
        for name in ("claims", "log"):
            fs, path = self._at(name)
            fs.mkdirs(path)
        return True

    # the log

    def _newest(self, kind: str, done: str) -> int | None:
        """The number of the newest ``state`` or ``index`` that was written as a whole."""
        numbers = sorted(int(n.split("-")[1]) for n in self._names() if n.startswith(f"{kind}-"))
        return next((n for n in reversed(numbers) if self._there(f"{kind}-{n}/{done}/_SUCCESS")), None)

    def _appends(self, state: int | None) -> list[str]:
        """The appends that a state hasn't taken in, in the order of their names."""
        taken = set()
        if state is not None:
            taken = {r[0] for r in self.spark.read.parquet(f"{self.path}/state-{state}/appends").collect()}
        return sorted(n for n in self._names("log") if n.startswith("origin=") and n not in taken and self._there(f"log/{n}/_SUCCESS"))

    def _read(self, state: int | None, appends: list[str]) -> DataFrame:
        """(doc_id, seq, op, source, origin, writes, since): a state's rows, and of appends every write."""
        out = self.spark.createDataFrame([], LOG_ROWS)
        if state is not None:
            out = self.spark.read.schema(LOG_ROWS).parquet(f"{self.path}/state-{state}/rows")
        if appends:
            folders = [f"{self.path}/log/{n}" for n in appends]
            rows = self.spark.read.schema(OP_LOG + ", origin string").option("basePath", f"{self.path}/log").parquet(*folders)
            out = out.unionByName(rows, allowMissingColumns=True) if state is not None else rows.withColumns({c: F.lit(None).cast("long") for c in ("writes", "since")})
        return out

    def log(self) -> DataFrame:
        """(doc_id, seq, op, source, ...): the last compacted write of every id, and every write since."""
        state = self._newest("state", "appends")
        return self._read(state, self._appends(state))

    def append(self, ops: DataFrame, origin: str | None = None, claimed: bool = False) -> None:
        """Add writes (doc_id, seq, op, source); an ``origin`` that is there is replaced.

        Numbers that weren't ``claimed`` are made known, so that later writes have greater ones.
        """
        self.create_index_if_needed()
        at = f"{self.path}/log/origin={origin or uuid.uuid4().hex}"
        ops.select("doc_id", "seq", "op", "source").write.mode("overwrite").option("parquet.bloom.filter.enabled#doc_id", "true").parquet(at)
        if not claimed:
            last = self.spark.read.schema(OP_LOG).parquet(at).agg(F.max("seq")).first()[0]
            if last is not None and last > self.last_seq():
                self._claim(last)

    def last_seq(self) -> int:
        """The greatest number taken; no data is read for it."""
        return max([int(n) for n in self._names("claims") if n.isdigit()] + [self._newest("state", "appends") or 0])

    def _claim(self, least: int = 0) -> int:
        """Take the next number, ``least`` or more: whoever makes its file has it."""
        self.create_index_if_needed()
        seq = max(least, self.last_seq() + 1)
        while True:
            fs, path = self._at(f"claims/{seq:020d}")
            try:
                if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and makes then
                    jvm, none = self.spark._jvm, self.spark.sparkContext._gateway.new_array(self.spark._jvm.String, 0)
                    attributes = self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
                    jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Paths.get(path.toUri().getPath(), none), attributes)
                else:
                    fs.create(path, False).close()
                return seq
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                seq += 1

    def compact(self) -> int | None:
        """Bring the log into a new state; its number, or None if nothing was ever written.

        Appends that are made meanwhile stay in the log.  What the state before
        the last held is deleted now, as readers may still have had it open.
        """
        state = self._newest("state", "appends")
        appends = self._appends(state)
        if not appends:
            return state
        seq, taken = self.last_seq(), [] if state is None else [r[0] for r in self.spark.read.parquet(f"{self.path}/state-{state}/appends").collect()]
        if state is not None and seq <= state:  # late appends of numbers that were taken before
            seq = self._claim()
        rows = self._read(state, appends).withColumn("since", F.coalesce("since", F.lit(seq)))
        by_id = op_log.compacted(rows).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        to = f"{self.path}/state-{seq}"
        by_id.write.mode("overwrite").option("compression", "zstd").option("parquet.bloom.filter.enabled#doc_id", "true").parquet(f"{to}/rows")
        left = [n for n in taken if self._there(f"log/{n}")]
        older = [n for n in self._names() if n.startswith("state-") and int(n.split("-")[1]) < (state or 0)]
        self.spark.createDataFrame([(n,) for n in appends], "name string").coalesce(1).write.mode("overwrite").parquet(f"{to}/appends")
        self._drop(*older, *(f"log/{n}" for n in left), *(f"claims/{n}" for n in self._names("claims") if n.isdigit() and int(n) < seq))
        return seq

    # one document

    def index(self, doc_id: str, body: dict | str) -> dict:
        """Put a document in the place of whatever has its id; the write's acknowledgement."""
        source = body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)
        row = self.spark.createDataFrame([(doc_id, source)], "doc_id string, source string")
        if not corpus.rejected(row).isEmpty():
            raise InvalidDocument(doc_id)
        present, version = self._standing(doc_id)
        seq = self._claim()
        self.append(row.select("doc_id", F.lit(seq).cast("long").alias("seq"), F.lit("index").alias("op"), "source"), claimed=True)
        return {"_id": doc_id, "result": "updated" if present else "created", "_version": version + 1, "_seq_no": seq}

    def _standing(self, doc_id: str) -> tuple[bool, int]:
        last = op_log.settled(self.log().where(F.col("doc_id") == doc_id)).agg(F.max_by("op", F.struct("seq", "origin")), F.max("version")).first()
        return last[0] == "index", last[1] or 0

    def index_all(self, bodies: DataFrame) -> None:
        """Put many documents (doc_id, source) in one write; of bodies with one id, the greatest as a string."""
        one = bodies.select(F.col("doc_id").cast("string").alias("doc_id"), "source").groupBy("doc_id").agg(F.max("source").alias("source"))
        self.append(one.select("doc_id", F.lit(self._claim()).cast("long").alias("seq"), F.lit("index").alias("op"), "source"), claimed=True)

    def get(self, doc_id: str) -> dict:
        """A document's body; DocumentNotFound if there is none."""
        found = op_log.snapshot(self.log().where(F.col("doc_id") == doc_id)).first()
        if found is None:
            raise DocumentNotFound(doc_id)
        return json.loads(found["source"])

    def delete(self, doc_id: str) -> dict:
        """Delete a document; DocumentNotFound, and nothing logged, if there is none."""
        if not self._standing(doc_id)[0]:
            raise DocumentNotFound(doc_id)
        ops = self.spark.createDataFrame([(doc_id, self._claim(), "delete", None)], OP_LOG)
        self.append(ops, claimed=True)
        return {"deleted": doc_id}

    # search

    def documents(self) -> DataFrame:
        return corpus.from_bodies(op_log.snapshot(self.log()))

    def mapping(self) -> dict[str, list[str]]:
        """Each field of the bodies and the types that its values show."""
        out: dict[str, list[str]] = {}
        for r in corpus.dynamic_fields(op_log.snapshot(self.log())).orderBy("field", "type").collect():
            out.setdefault(r["field"], []).append(r["type"])
        return out

    def refresh(self) -> str | None:
        """Compact the log and write the index of the state; later writes are searched as its tail."""
        state = self.compact()
        if state is None:
            return None
        to = f"{self.path}/index-{state}"
        if not self._there(f"index-{state}/stats/_SUCCESS"):
            older = [n for n in self._names() if n.startswith("index-") and int(n.split("-")[1]) < (self._newest("index", "stats") or 0)]
            index_files.save(corpus.from_bodies(op_log.snapshot(self._read(state, []))), to)
            self._drop(*older)
        return to

    def current(self) -> Index | Layered | Scan:
        """What searches read: the index, with a tail if there were writes since; a scan without an index."""
        at = self._newest("index", "stats")
        if at is None:
            return Scan(self.documents())
        base, state = index_files.load(self.spark, f"{self.path}/index-{at}"), self._newest("state", "appends")
        appends = self._appends(state)
        if state == at and not appends:
            return base
        name = f"index-{at}/tail-{state}-{hashlib.sha256(' '.join(appends).encode()).hexdigest()[:16]}"
        if not self._there(f"{name}/stats/_SUCCESS"):
            self._write_tail(base, at, state, appends, name)
        return index_files.load_tail(base, f"{self.path}/{name}")

    def _write_tail(self, base: Index, at: int, state: int, appends: list[str], name: str) -> None:
        """The index of the ids written since the state ``at``; the tail before the last one is deleted."""
        since = self._read(state, []).where(F.col("since") > at).select("doc_id")
        ids = since.unionByName(self._read(None, appends).select("doc_id")).distinct()
        present = op_log.snapshot(index_files.with_ids(self._read(state, appends), ids))
        older = [n for n in self._names(f"index-{at}") if n.startswith("tail-")]
        made = f"{name}.{uuid.uuid4().hex}"  # written beside, so that two processes can't write into one folder
        index_files.save_tail(base, ids, corpus.from_bodies(present), f"{self.path}/{made}")
        fs, to = self._at(name)
        if fs.exists(to) or not fs.rename(self._at(made)[1], to):
            self._drop(made)
        times = {n: fs.getFileStatus(self._at(f"index-{at}/{n}")[1]).getModificationTime() for n in older if self._there(f"index-{at}/{n}")}
        newest = max(times, key=times.get, default=None)
        self._drop(*(f"index-{at}/{n}" for n in times if n != newest))

    def search_frame(self, q: str, size: int = DEFAULT_SIZE) -> DataFrame:
        """(title, content, tags, source, _score), best first."""
        return search(self.current(), q, size).drop("doc_id")

    def search(self, q: str, size: int = DEFAULT_SIZE) -> list[dict]:
        """The best documents' bodies, each with its ``_score``."""
        if not isinstance(size, int) or not 0 <= size <= LARGEST_SIZE:
            raise InvalidSize(f"size {size} is not in 0..{LARGEST_SIZE}")
        return [json.loads(r["source"]) | {"_score": r["_score"]} for r in self.search_frame(q, size).select("source", "_score").collect()]
