"""The vault on disk: versioned tables with a pointer, encrypted blobs and password backups."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.vault import Vault

MAGIC = "VEILVAULT1"
BACKUP = "VEILBACKUP1"
_TABLES = ("entities", "spellings", "counters")
#: Rows of a table that one part of a backup holds on average.
PART = 50_000


def encrypted(content: Column, key: bytes, magic: str = MAGIC) -> Column:
    """AES-GCM under a 256-bit key, with the magic string authenticated and in front."""
    blob = F.call_function("aes_encrypt", content, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(magic.encode()))
    return F.concat(F.lit(magic.encode()), blob)


def decrypted(blob: Column, key: bytes, magic: str = MAGIC) -> Column:
    """The content of an encrypted blob; null if the key or the blob is wrong."""
    body = F.substr(blob, F.lit(len(magic) + 1))
    return F.call_function("try_aes_decrypt", body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(magic.encode()))


def password_key(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=2**15, r=8, p=1, dklen=32, maxmem=2**27)


def _sealed(rows: DataFrame, columns: tuple[str, ...], key: bytes | None) -> DataFrame:
    """rows with what names somebody encrypted."""
    return rows if key is None else rows.withColumns({c: F.base64(encrypted(F.col(c).cast("binary"), key)) for c in columns if c in rows.columns})


def _opened(rows: DataFrame, columns: tuple[str, ...], key: bytes | None) -> DataFrame:
    if key is None:
        return rows
    out = rows
    for c in (c for c in columns if c in rows.columns):
        plain = decrypted(F.unbase64(F.col(c)), key).cast("string")
        wrong = F.raise_error(F.lit("the vault cannot be read: its key is another one, or it is damaged"))
        out = out.withColumn(c, F.when(F.col(c).isNull(), None).when(plain.isNull(), wrong).otherwise(plain))
    return out


class VaultStore:
    """Versions of a vault under one folder. A commit writes a new version, then claims its number.

    The pointer of a version is a file named by its number alone, made only if it is not there yet, so
    of two writers that start from one version the second is refused. Readers see the last version
    that has a pointer, whole. With a key, entity keys and spellings lie encrypted (AES-GCM).
    """

    SEALED = ("key", "spelling")

    def __init__(self, spark: SparkSession, folder: str, key: bytes | None = None):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _text(self, name: str) -> str:
        lines = self.spark.read.text(f"{self.folder}/{name}").collect()
        return lines[0][0] if lines else ""

    def _put(self, name: str, text: str) -> None:
        """Makes a file; an error if it is there."""
        out = self._fs().create(self._path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def versions(self) -> list[str]:
        if not self._fs().exists(self._path("pointers")):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path("pointers")))

    def id(self) -> str:
        """The id of the vault: documents are stamped with it. clear() makes a new one."""
        names = sorted(s.getPath().getName() for s in self._fs().listStatus(self._path("ids"))) if self._fs().exists(self._path("ids")) else []
        if names:
            return names[-1].split("-")[1]
        self._fs().mkdirs(self._path("ids"))
        self._put(f"ids/{0:06d}-{uuid.uuid4().hex}", "")
        return self.id()

    def read(self) -> tuple[str, Vault]:
        """(version, vault); an empty vault has the version ''."""
        names = self.versions()
        if not names:
            return "", Vault.empty(self.spark)
        data = self._text(f"pointers/{names[-1]}")
        return names[-1], Vault(*(_opened(self.spark.read.parquet(f"{self.folder}/{data}/{t}"), self.SEALED, self.key) for t in _TABLES))

    def commit(self, vault: Vault, base: str) -> str:
        """Writes the next version after base and points to it; a RuntimeError if another job did so first."""
        number = f"{int(base or 0) + 1:012d}"
        data = f"data-{number}-{uuid.uuid4().hex[:8]}"
        for table in _TABLES:
            _sealed(getattr(vault, table), self.SEALED, self.key).write.parquet(f"{self.folder}/{data}/{table}")
        self._fs().mkdirs(self._path("pointers"))
        late = (self.versions() or [""])[-1] != base
        try:
            if not late:
                self._put(f"pointers/{number}", data)
                return number
        except Py4JJavaError:
            late = True
        self._fs().delete(self._path(data), True)
        raise RuntimeError("another job committed to the vault first; read it again and repeat")

    def rollback(self, version: str) -> None:
        """Back to an earlier version: later pointers go, so numbering goes on from there."""
        for name in self.versions():
            if name > version:
                self._fs().delete(self._path(f"pointers/{name}"), True)

    def clear(self) -> str:
        """Forgets everything; numbering starts anew, and therefore the vault has a new id."""
        n = len(self._fs().listStatus(self._path("ids"))) if self._fs().exists(self._path("ids")) else 0
        self.commit(Vault.empty(self.spark), (self.versions() or [""])[-1])
        self._fs().mkdirs(self._path("ids"))
        self._put(f"ids/{n:06d}-{uuid.uuid4().hex}", "")
        return self.id()

    def export(self, password: str) -> DataFrame:
        """One row for each part of a backup: table, part, parts, salt, content (encrypted JSON lines of about PART rows)."""
        _, vault = self.read()
        salt = os.urandom(16)
        key = password_key(password, salt)
        whole = None
        for table in _TABLES:
            rows = getattr(vault, table)
            n = max(1, -(-rows.count() // PART))
            part = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(n)).cast("int").alias("part"), F.to_json(F.struct(*rows.columns)).alias("line"))
            part = part.groupBy("part").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
            # a part without rows is a row as well, so that a missing one is seen
            part = self.spark.range(n).select(F.col("id").cast("int").alias("part")).join(part, "part", "left")
            part = part.select(F.lit(table).alias("table"), "part", F.lit(n).alias("parts"), F.coalesce("text", F.lit("")).alias("text"))
            whole = part if whole is None else whole.unionByName(part)
        name = F.concat_ws("/", "table", "part", "parts", "text")
        return whole.select("table", "part", "parts", F.lit(salt).alias("salt"), encrypted(name.cast("binary"), key, BACKUP).alias("content"))

    def load_backup(self, backup: DataFrame, password: str) -> Vault:
        """The vault of a backup; a ValueError if the password is wrong, or if any part is damaged or missing."""
        from ..operators.vault import COUNTERS, ENTITIES, SPELLINGS

        first = backup.select("salt").first()
        if first is None:
            raise ValueError("the backup is empty")
        key = password_key(password, bytes(first["salt"]))
        text = decrypted(F.col("content"), key, BACKUP).cast("string")
        head = F.concat_ws("/", "table", "part", "parts", F.lit(""))
        rows = backup.select("table", "part", "parts", F.when(F.startswith(text, head), F.substr(text, F.length(head) + 1)).alias("text"))
        if rows.where("text IS NULL").limit(1).count():
            raise ValueError("the password is wrong or the backup is damaged")
        sizes = {r["table"]: (r["n"], r["parts"]) for r in rows.groupBy("table").agg(F.count_distinct("part").alias("n"), F.max("parts").alias("parts")).collect()}
        if set(sizes) != set(_TABLES) or any(n != parts for n, parts in sizes.values()):
            raise ValueError("the backup is damaged: parts are missing")
        lines = rows.where("text != ''").select("table", F.explode(F.split("text", "\n")).alias("line"))
        of = lambda t, s: lines.where(F.col("table") == t).select(F.from_json("line", s).alias("r")).select("r.*")
        return Vault(of("entities", ENTITIES), of("spellings", SPELLINGS), of("counters", COUNTERS))


def run_record(run_id: str, kind: str, files: list[str], tokens: list[str]) -> str:
    """One line of the history."""
    return json.dumps({"id": run_id, "kind": kind, "files": files, "tokens": sorted(tokens)}, ensure_ascii=False)


def history(records: DataFrame, most: int = 200) -> DataFrame:
    """The last runs of a history (id, time, kind, files, tokens), newest first: a rule of the product keeps 200."""
    return records.orderBy(F.desc("time"), "id").limit(most)


def remembered(prefs: DataFrame, choices: DataFrame) -> DataFrame:
    """prefs (folded, choice) with the choices of this run in place of earlier ones."""
    return prefs.join(choices.select("folded"), "folded", "left_anti").unionByName(choices.select("folded", "choice"))
