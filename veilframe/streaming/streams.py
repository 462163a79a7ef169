"""Streams of texts. Extensions: the engine's semantics are those of its batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.restore import restore
from ..operators.vault import Vault
from ..plans.engine import Settings, pseudonymize
from ..sources.store import VaultStore


def restored_batches(stream: DataFrame, vault: Vault, keys: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text"):
    """Restores each micro-batch of a stream with one version of the vault."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(restore(df, vault, keys, text), n)).option("checkpointLocation", checkpoint)


def pseudonymized_batches(stream: DataFrame, store: VaultStore, keys: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text", settings: Settings = Settings()):
    """Pseudonymises each micro-batch as one job: it reads the vault, commits the next version, then hands the texts over.

    A batch that is repeated after a failure finds its entities in the vault and gives the same tokens.
    """

    def job(df: DataFrame, n: int) -> None:
        version, vault = store.read()
        result = pseudonymize(df, vault, keys, text, settings)
        store.commit(result.vault, version)
        sink(result.units, n)

    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
