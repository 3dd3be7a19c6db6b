"""Feature tracks: each is fitted on a catalogue, applied to rows, and kept in an artifact store."""
