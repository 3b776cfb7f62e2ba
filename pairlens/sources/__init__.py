from .tables import read_replicate, read_source, replicate_ids, write_replicates

__all__ = ["read_replicate", "read_source", "replicate_ids", "write_replicates"]
