"""Answers kept cell by cell while a run is under way.

A completion costs time and money, so an answer is put down as soon as it is there, in the folder
that all tasks share. A task that is started again, or a run that is, finds the answers of its cells
and calls only for the others.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class Ledger:
    """Answers below ``folder`` (a URI or an absolute path), one record for each run, cell and attempt.

    Name another ``attempt`` to call again for cells that have an answer already, as a retry does.
    """

    folder: str
    attempt: str = "first"

    def _place(self, run_id: str, seq: int) -> tuple[fs.FileSystem, str, str]:
        system, root = fs.FileSystem.from_uri(self.folder)
        name = hashlib.sha256(json.dumps([run_id, seq, self.attempt]).encode()).hexdigest()
        return system, f"{root}/{name[:2]}", f"{name}.json"

    def find(self, run_id: str, seq: int) -> tuple[str | None, dict] | None:
        """Error and response of a cell, or None if it has no answer yet."""
        system, folder, name = self._place(run_id, seq)
        if system.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(f"{folder}/{name}") as record:
            kept = json.loads(record.read())
        return kept["error"], kept["response"]

    def keep(self, run_id: str, seq: int, error: str | None, response: dict) -> None:
        """Put an answer down: written under another name first, so that a record is whole or absent."""
        system, folder, name = self._place(run_id, seq)
        system.create_dir(folder, recursive=True)
        draft = f"{folder}/{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as record:
            record.write(json.dumps({"error": error, "response": response}).encode())
        system.move(draft, f"{folder}/{name}")
