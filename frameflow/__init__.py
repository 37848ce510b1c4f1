"""frameflow: DataFrame operators for keyed, sequence-numbered particle streams."""

__version__ = "0.1.0"
