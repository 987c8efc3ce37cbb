"""Extension surface: annotators, detectors and formats as registered functions.

An annotator turns a token table into a token table. Tasks say what it fills; a
pipeline runs only the annotators whose tasks are wanted, so work that nobody asked
for isn't planned at all. REST and subprocess services fit in as functions of Arrow
batches (``per_partition``), which open their connection once a partition.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import partial
from importlib.metadata import entry_points

from pyspark.sql import DataFrame

GROUP = "tagloom.annotators"


@dataclass
class Registry:
    """Named plug-ins, by name or alias."""

    items: dict[str, object] = field(default_factory=dict)

    def register(self, name: str, item, aliases: Iterable[str] = ()):
        for n in (name, *aliases):
            self.items[n.lower()] = item
        return item

    def get(self, name: str):
        try:
            return self.items[name.lower()]
        except KeyError:
            raise KeyError(f"{name!r} is not registered; there are: {', '.join(sorted(self.items))}") from None


@dataclass(frozen=True)
class Annotator:
    name: str
    tasks: frozenset[str]
    apply: Callable[[DataFrame], DataFrame]
    train: Callable[[DataFrame], object] | None = None

    @property
    def supports_training(self) -> bool:
        return self.train is not None


ANNOTATORS, DETECTORS, READERS, WRITERS = Registry(), Registry(), Registry(), Registry()


def annotator(name: str, tasks: Iterable[str], train=None, aliases=()):
    """Decorator that registers a DataFrame-to-DataFrame function."""

    def add(f):
        ANNOTATORS.register(name, Annotator(name, frozenset(tasks), f, train), aliases)
        return f

    return add


def create(name: str, **options) -> Annotator:
    """The annotator of that name with options bound to its function; options that are None are left out."""
    a = ANNOTATORS.get(name)
    given = {k: v for k, v in options.items() if v is not None}
    return replace(a, apply=partial(a.apply, **given)) if given else a


def command(argv: list[str], schema: str) -> Callable[[DataFrame], DataFrame]:
    """An annotator that pipes each batch through a program: the column ``form``, a line a token, goes
    in; as many lines come out, as ``pred``. A program that fails, or says too little, raises."""

    def apply(tokens: DataFrame) -> DataFrame:
        def open_session():
            import subprocess

            def send(frame):
                if not len(frame):
                    return frame.assign(pred=[])
                text = "".join(f"{x}\n" for x in frame["form"].fillna(""))
                done = subprocess.run(argv, input=text, capture_output=True, text=True, check=True)
                lines = done.stdout.split("\n")[: len(frame)]
                if len(lines) < len(frame):
                    raise ValueError(f"{argv[0]}: {len(lines)} lines for {len(frame)} tokens")
                return frame.assign(pred=lines)

            return send

        return per_partition(tokens, open_session, schema)

    return apply


def discover() -> list[str]:
    """Load annotators that installed packages offer as entry points."""
    found = []
    for e in entry_points(group=GROUP):
        found.append(e.name)
        e.load()
    return found


def per_partition(tokens: DataFrame, open_session: Callable, schema: str) -> DataFrame:
    """Annotate through a service: ``open_session()`` gives, once a partition, a
    function from a batch (pandas) to a batch."""

    def run(frames):
        send = open_session()
        for f in frames:
            yield send(f)

    return tokens.mapInPandas(run, schema)


def run_pipeline(tokens: DataFrame, names: list[str], tasks: Iterable[str] | None = None) -> DataFrame:
    """Apply annotators in order, but only those with a wanted task."""
    wanted = None if tasks is None else set(tasks)
    for n in names:
        a = ANNOTATORS.get(n)
        if wanted is None or a.tasks & wanted:
            tokens = a.apply(tokens)
    return tokens


def register_formats() -> None:
    """Put the formats and the detector of this package into the registries; done at import."""
    from .operators.language import detect
    from .sources import conllu, tei

    READERS.register("conllu", conllu.read_conllu, ("conll-u",))
    READERS.register("teitok", tei.read_tei, ("tei", "xml"))
    WRITERS.register("conllu", conllu.write_conllu, ("conll-u",))
    WRITERS.register("teitok", tei.write_tei, ("tei", "xml"))
    DETECTORS.register("trigrams", detect)


register_formats()
