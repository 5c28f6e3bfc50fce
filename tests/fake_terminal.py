"""A terminal whose candles and failures are told by a file."""

import json
from pathlib import Path


class Fake:
    def __init__(self, options):
        self.file = Path(options["state"])
        self.said = json.loads(self.file.read_text())

    def _note(self, **changes):
        self.said = json.loads(self.file.read_text()) | changes
        self.file.write_text(json.dumps(self.said))

    def connect(self):
        self.said = json.loads(self.file.read_text())
        if self.said["fails"]:
            self._note(fails=self.said["fails"] - 1, failed=self.said.get("failed", 0) + 1)
            return False
        return True

    def disconnect(self):
        with (self.file.parent / "closed").open("a") as out:
            out.write(".")

    def tick(self, symbol):
        return None

    def rates(self, symbol, minutes, count):
        """Candle k begins at ``first`` + k steps; the last one is forming."""
        n, first = self.said["n"], self.said["first"]
        ks = range(0, n, 2 if symbol == "quiet" else 1)
        return [(first + 60 * minutes * k, 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k - (0.25 if k == n - 1 else 0), float(k), 0.0, 0.0) for k in ks[-count:]]


def make(options):
    return Fake(options)
