"""Tables, observation files, snapshots and sinks."""
