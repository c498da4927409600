"""Shift predictors: a protocol, and a rule-based stand-in for models that aren't here.

A predictor takes structure strings and gives both nuclei's peaks, one batch at a time; ``predicted`` makes it a column.
Models plug in by the same signature (load once a process, then predict batches).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions import structures as S

Predictor = Callable[[list[str]], list[tuple[list[float], list[float]]]]
PEAKS = T.StructType([T.StructField("h", T.ArrayType(T.DoubleType())), T.StructField("c", T.ArrayType(T.DoubleType()))])
#: Fixed values of the stand-in: base shifts and what a neighbour adds, for carbon and for its hydrogens.
BASE_C = {"aromatic": 128.0, "carbonyl": 175.0, "double": 122.0, "triple": 75.0, "single": 15.0}
BASE_H = {"aromatic": 7.2, "carbonyl": 9.6, "double": 5.3, "triple": 2.2, "single": 0.9}
ADDS_C = {"C": 8.0, "N": 28.0, "O": 45.0, "S": 15.0, "F": 65.0, "Cl": 28.0, "Br": 18.0}
ADDS_H = {"C": 0.35, "N": 1.7, "O": 2.5, "S": 1.3, "F": 3.3, "Cl": 2.2, "Br": 2.0}


def rule_based(texts: list[str]) -> list[tuple[list[float], list[float]]]:
    out = []
    for text in texts:
        try:
            m = S.parse(text)
        except (ValueError, KeyError, IndexError):
            out.append(([], []))
            continue
        h, c = [], []
        for i, (atom, near, hydrogens) in enumerate(zip(m.atoms, m.around(), m.implicit(), strict=True)):
            if atom.element == "C":
                orders = {o for _, o in near}
                oxo = any(o == 2 and m.atoms[j].element == "O" for j, o in near)
                kind = "aromatic" if atom.aromatic else "carbonyl" if oxo else "triple" if 3 in orders else "double" if 2 in orders else "single"
                around = [m.atoms[j].element for j, o in near if o == 1]
                c.append(BASE_C[kind] + sum(ADDS_C.get(e, 0.0) for e in around) * (0.25 if kind != "single" else 1.0))
                h += [round(BASE_H[kind] + sum(ADDS_H.get(e, 0.0) for e in around) * (0.25 if kind != "single" else 1.0), 4)] * hydrogens
            elif atom.element in ("O", "N"):
                h += [2.0 if atom.element == "N" else 3.5] * hydrogens
        out.append((sorted(h), sorted(round(x, 4) for x in c)))
    return out


def predicted(column: Column | str, predictor: Predictor = rule_based) -> Column:
    """struct(h, c) of each structure."""

    @F.pandas_udf(PEAKS)
    def run(s: pd.Series) -> pd.DataFrame:
        known = s.fillna("").tolist()
        return pd.DataFrame(predictor(known), columns=["h", "c"])

    return run(column)
