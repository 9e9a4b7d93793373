"""Method descriptors in the forms that traces, event logs and profiler listings use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JVM descriptors of the primitive types.
PRIMITIVES = {"int": "I", "byte": "B", "char": "C", "double": "D", "float": "F", "long": "J", "short": "S", "boolean": "Z"}
# Listing entries that name no method.
PSEUDO = ("<Total>", "<JVM-System>", "<no Java callstack recorded>")


def method_descriptor(site: Column) -> Column:
    """``30 java/io/PrintStream.write([BII)V ...`` to ``java.io.PrintStream write ([BII)V``."""
    method = F.split(site, " ")[1]
    at = F.instr(method, "(")
    return F.concat_ws(" ", F.translate(F.substring_index(method, "(", 1), "./", " ."), F.substr(method, at))


def method_name(site: Column) -> Column:
    """The second word of a site up to its first closing bracket."""
    return F.regexp_extract(site, r"^\S+ ([^)]*\))", 1)


def argument_descriptor(arg: Column) -> Column:
    """``int`` to ``I``, ``byte[]`` to ``[B``, ``java.lang.String`` to ``Ljava/lang/String;``."""
    base = F.replace(arg, F.lit("[]"), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])
    depth = F.floor((F.length(arg) - F.length(base)) / 2).cast("int")
    return F.concat(F.repeat(F.lit("["), depth), F.coalesce(F.try_element_at(known, base), F.concat(F.lit("L"), F.replace(base, F.lit("."), F.lit("/")), F.lit(";"))))


def hot_descriptor(name: Column, bare_argument: bool = False) -> Column:
    """A listing's method name as a descriptor without return type; names that aren't methods stay.

    A method without arguments gets ``()``; with ``bare_argument`` it gets ``(L;)``, the form of an
    empty class name.
    """
    left = F.substring_index(name, "(", 1)
    last = F.substring_index(left, ".", -1)
    owner = F.substr(left, F.lit(1), F.length(left) - F.length(last))
    path = F.concat(F.translate(F.substr(owner, F.lit(1), F.length(owner) - 1), ".", "/"), F.when(owner != "", F.lit(".")).otherwise(F.lit("")), last)
    args = F.replace(F.split(name, r"\(", -1)[1], F.lit(")"), F.lit(""))
    parts = F.split(args, ", ", -1) if bare_argument else F.filter(F.split(args, ", ", -1), lambda a: a != "")
    pseudo = name.isin(*PSEUDO) | name.startswith("<static>") | ~F.contains(name, F.lit("(")) | F.contains(name, F.lit("::"))
    return F.when(pseudo, name).otherwise(F.concat(path, F.lit("("), F.array_join(F.transform(parts, argument_descriptor), ""), F.lit(")")))


def strip_hidden(name: Column) -> Column:
    """Without the address of a hidden class."""
    return F.regexp_replace(name, r"\.0x\w+", "")
