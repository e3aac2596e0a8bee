"""Sources and sinks: JSON lines and arrays, the run registry, chunk tables, inventories, snapshots."""
