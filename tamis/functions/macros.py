"""Named chains made by functions, and a registry of steps from other packages."""

from __future__ import annotations

import functools
import inspect
import warnings
from collections.abc import Callable, Iterator
from importlib import metadata
from types import ModuleType

from tamis.plans.core import Chain, Step, to_step

GROUP = "tamis.steps"


class Macro:
    """A function that returns a step, used like a step's class: called for a step, or piped as it is."""

    def __init__(self, make: Callable, *args: object, **kwargs: object):
        self.make, self.args, self.kwargs = make, args, kwargs
        functools.update_wrapper(self, make)

    def __call__(self, *args: object, **kwargs: object) -> Chain:
        return Chain(to_step(self.make(*self.args, *args, **{**self.kwargs, **kwargs})))

    def __or__(self, other: object) -> Chain:
        return self() | other

    def __ror__(self, other: object) -> Chain:
        return to_step(other) | self()


def macro(make: Callable | None = None, *args: object, **kwargs: object):
    """Decorator for functions that return steps. With a step's class and keywords it gives a variant of the class whose
    keywords are preset and may be given anew: macro(Max, exclusive=True)."""
    if make is None:
        return functools.partial(macro, *args, **kwargs)
    return Macro(make, *args, **kwargs)


def is_step(x: object) -> bool | str:
    """True for a class of steps or a macro; else why it is none."""
    if isinstance(x, Macro):
        return True
    if not inspect.isclass(x):
        return "is no class"
    if not issubclass(x, Step):
        return "is no subclass of Step"
    return True if not inspect.isabstract(x) else "is abstract"


class Registry:
    """Steps by name: registered here, or found in other packages' entry points. An attribute is the class or macro."""

    def __init__(self, group: str = GROUP):
        self.group = group
        self._known: dict[str, object] | None = None

    def _load(self) -> dict[str, object]:
        if self._known is None:
            self._known = {}
            for point in metadata.entry_points(group=self.group):
                found = point.load()
                self._known[point.name] = self._checked(found, point.name)
        return self._known

    @staticmethod
    def _checked(x: object, name: str) -> object:
        if (why := is_step(x)) is not True:
            raise TypeError(f"{name} {why}")
        return x

    def register(self, name: str, x: object) -> None:
        self._load()[name] = self._checked(x, name)

    def __getattr__(self, name: str) -> object:
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self._load()[name]
        except KeyError:
            raise AttributeError(f"no step is registered as {name}") from None

    __getitem__ = __getattr__

    def __dir__(self) -> list[str]:
        return sorted(self._load())

    def __len__(self) -> int:
        return len(self._load())

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._load()))


ext = Registry()


def steps_in(module: ModuleType) -> Iterator[tuple[str, object]]:
    """Classes of steps that a module defines. Register them instead."""
    warnings.warn("steps_in goes; name steps as entry points or register them", DeprecationWarning, stacklevel=2)
    for name, x in inspect.getmembers(module):
        if is_step(x) is True and not name.startswith("_"):
            yield name, x
