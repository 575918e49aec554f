"""Paged listings as a data source: one input partition for each letter, pages until the listing says it is done."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: From (letter, page from 1) to a page: content, a list of entries, and totalPages where it is known.
Fetch = Callable[[str, int], dict]
FIELDS = "letter string, page int, nomeProduto string, idBulaPacienteProtegido string, error string"


def pages(fetch: Fetch, letter: str, tries: int = 3, wait: float = 1.0) -> Iterator[tuple[int, list[dict], str | None]]:
    """(page, entries, error) of a letter. A page that fails is asked again; one that always fails ends the letter with an
    error and no entries. An empty page ends it too, and the last one where the number of pages is known."""
    page = 1
    while True:
        for left in range(tries - 1, -1, -1):
            try:
                data = fetch(letter, page)
                break
            except Exception as e:  # any client's error: the page is tried again, at last it is a row
                if not left:
                    yield page, [], f"{type(e).__name__}: {e}"
                    return
                time.sleep(wait)
        entries, total = data.get("content") or [], data.get("totalPages")
        if not entries:
            return
        yield page, entries, None
        page += 1
        if total is not None and page > total:
            return


class _Letter(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, factory: Callable[[], Fetch], options: dict, names: Sequence[str]):
        self.factory, self.names = factory, list(names)
        self.letters = list(dict.fromkeys(x.strip() for x in options.get("letters", ",".join("abcdefghijklmnopqrstuvwxyz")).split(",") if x.strip()))
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 1.0))

    def partitions(self) -> list[InputPartition]:
        return [_Letter(x) for x in self.letters]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        fetch, letter = self.factory(), partition.value
        for page, entries, error in pages(fetch, letter, self.tries, self.wait):
            for entry in entries or [{}]:
                row = {"letter": letter, "page": page, "nomeProduto": entry.get("nomeProduto"), "idBulaPacienteProtegido": entry.get("idBulaPacienteProtegido"), "error": error}
                yield tuple(row[n] for n in self.names)


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Letters asked for by = or IN are the only ones fetched."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("letter",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.letters = [x for x in self.letters if x in wanted]
            else:
                yield f


def listing_source(factory: Callable[[], Fetch], name: str = "paged_listing", pushdown: bool = False) -> type[DataSource]:
    """A data source to register: spark.dataSource.register(listing_source(factory)), then spark.read.format(name).load().

    The factory makes the client on the worker, once for a letter. Options: letters (comma-separated, a to z by default),
    tries and wait (seconds) of a page that fails. A schema of fewer columns reads these only. With
    pushdown, which asks for spark.sql.python.filterPushdown.enabled, a filter on letter keeps other letters from being fetched.
    """

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return FIELDS

        def reader(self, schema: StructType) -> _Reader:
            return (_FilteringReader if pushdown else _Reader)(factory, dict(self.options), schema.names)

    return Listing
