"""seqtally: DataFrame operators for tables of sequence-alignment hits and gene annotation."""

__version__ = "0.1.0"
