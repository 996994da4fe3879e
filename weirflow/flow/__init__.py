"""The driver side: stage graphs, retries, cancellation, sagas, schedules, stores."""
