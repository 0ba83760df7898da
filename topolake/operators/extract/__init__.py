"""Table-valued extraction from source files: runtime topology, signatures, references, capabilities."""
