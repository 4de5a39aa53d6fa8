"""Errors of the corpus API."""


class CorpusError(Exception):
    """Any failure of a corpus operation."""


class TrajectoryExists(CorpusError):
    def __init__(self, ids):
        super().__init__(f"trajectories already stored: {sorted(ids)[:10]}")
        self.ids = list(ids)


class MissingFrame(CorpusError):
    def __init__(self, key):
        super().__init__(f"no frame {key}")
        self.key = key


class MissingTrajectory(CorpusError):
    pass


class ConcurrentCommit(CorpusError):
    """Another writer published first; read again and retry."""


class ParseError(CorpusError, ValueError):
    """Frame text that does not follow the format."""
