"""Topologies: atoms and bonds, read from PDB files or given as tables."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.selection import Atom, resolve
from ..functions.units import standard_atomic_mass_da
from .files import filesystem

ATOMS = "atom_index long, name string, residue_name string, residue_index int, chain string, element string, mass_da double"
_identity = itertools.count(1)


def pdb_field(line: str, at: int, width: int) -> str:
    return line[at : at + width].strip()


@dataclass(frozen=True)
class Topology:
    """Atoms and bonds of one system; small, so that it is kept on the driver and sent with the kernels."""

    atoms: tuple[Atom, ...]
    bonds: tuple[tuple[int, int], ...] = ()
    identity: int = 0

    @classmethod
    def of(cls, atoms, bonds=()) -> Topology:
        """Missing masses come from the elements; bonds are sorted, distinct and between different atoms."""
        atoms = tuple(a if a.mass_da > 0 else replace(a, mass_da=standard_atomic_mass_da(a.element)) for a in atoms)
        own = sorted({(min(a, b), max(a, b)) for a, b in bonds})
        for a, b in own:
            if a == b or b >= len(atoms) or a < 0:
                raise ValueError(f"Invalid bond between atoms {a} and {b}")
        return cls(atoms, tuple(own), next(_identity))

    @classmethod
    def from_pdb(cls, path: str) -> Topology:
        fs, own = filesystem(str(path))
        with fs.open_input_stream(own) as f:
            return cls.parse_pdb(f.read().decode("utf-8", "replace").splitlines(), str(path))

    @classmethod
    def parse_pdb(cls, lines: list[str], path: str = "") -> Topology:
        """The atoms of the first model, and the bonds of CONECT records between them."""
        atoms, index_of, bonds = [], {}, []
        models, open_ = 0, True
        for line in lines:
            head = line[:6]
            if head == "MODEL ":
                models += 1
                open_ = models == 1
            elif head == "ENDMDL":
                open_ = False
            elif head == "CONECT":
                try:
                    source = int(pdb_field(line, 6, 5))
                    bonds += [(source, int(t)) for at in range(11, len(line), 5) if (t := pdb_field(line, at, 5))]
                except ValueError:
                    raise ValueError(f"Malformed PDB CONECT record: {line}") from None
            elif head in ("ATOM  ", "HETATM") and open_:
                try:
                    serial, residue = int(pdb_field(line, 6, 5)), int(pdb_field(line, 22, 4))
                except ValueError:
                    raise ValueError(f"Malformed PDB atom record: {line}") from None
                name, element = pdb_field(line, 12, 4), pdb_field(line, 76, 2)
                if not element:
                    element = next((c.upper() for c in name if c.isascii() and c.isalpha()), "")
                index_of[serial] = len(atoms)
                atoms.append(Atom(len(atoms), name, pdb_field(line, 17, 3), residue, line[21:22] or " ", element))
        if not atoms:
            raise ValueError(f"PDB topology contains no ATOM/HETATM records: {path}")
        known = [(index_of[a], index_of[b]) for a, b in bonds if a in index_of and b in index_of]
        return cls.of(atoms, [(a, b) for a, b in known if a != b])

    def select(self, text: str) -> list[int]:
        return resolve(text, self.atoms)

    def atoms_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a.index, a.name, a.residue_name, a.residue_index, a.chain, a.element, a.mass_da) for a in self.atoms], ATOMS)

    def bonds_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.bonds), "a long, b long")
