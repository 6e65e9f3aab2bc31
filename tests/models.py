"""Row-at-a-time models of the rules, for comparison on small inputs."""

TERMINAL = {"completed", "failed", "cancelled"}


def fold_deliveries(tasks, deliveries, executions=(), handlers=("demo", "fail"), max_attempts=5):
    """tasks: id -> [type, status, version]; deliveries: (id, attempt, outcome) in order.

    Returns dispositions, final tasks and the set of executions.
    """
    state = {key: list(value) for key, value in tasks.items()}
    ran = set(executions)
    out = []
    for key, attempt, outcome in deliveries:
        task = state.get(key)
        if task is None:
            out.append("not_found")
            continue
        if task[1] in TERMINAL:
            out.append("terminal_noop")
            continue
        if task[1] == "processing":
            out.append("in_flight_noop")
            continue
        if attempt > max_attempts:
            ran.add((key, attempt))
            task[1], task[2] = "failed", task[2] + 1
            out.append("max_attempts_dlq")
            continue
        task[1], task[2] = "processing", task[2] + 1
        if task[0] not in handlers:
            ran.add((key, attempt))
            task[1], task[2] = "failed", task[2] + 1
            out.append("no_handler_dlq")
        elif (key, attempt) in ran:
            out.append("dup_execution_stuck")
        else:
            ran.add((key, attempt))
            task[2] += 1
            if outcome == "ok":
                task[1] = "completed"
                out.append("completed")
            elif outcome == "permanent":
                task[1] = "failed"
                out.append("permanent_dlq")
            elif attempt >= max_attempts:
                task[1] = "failed"
                out.append("exhausted_dlq")
            else:
                task[1] = "queued"
                out.append("requeued")
    return out, state, ran


def apply_in_order(tasks, updates):
    """tasks: id -> [status, version]; updates: (id, expected, status) in order."""
    state = {key: list(value) for key, value in tasks.items()}
    out = []
    for key, expected, status in updates:
        if key not in state:
            out.append("not_found")
        elif state[key][1] == expected:
            state[key] = [status, expected + 1]
            out.append("updated")
        else:
            out.append("version_conflict")
    return out, state


def counter_rates(samples, length):
    """samples: (seconds, value) of one series in order; tumbling windows of `length` seconds."""
    windows = {}
    for t, v in samples:
        windows.setdefault(t // length * length, []).append((t, v))
    rates = {}
    for start, points in windows.items():
        if len(points) < 2 or points[-1][0] == points[0][0]:
            continue
        inc = sum(b if b < a else b - a for (_, a), (_, b) in zip(points, points[1:]))
        covered = points[-1][0] - points[0][0]
        average = covered / (len(points) - 1)
        to_start, to_end = points[0][0] - start, start + length - points[-1][0]
        if to_start >= average * 1.1:
            to_start = average / 2
        if inc > 0 and points[0][1] >= 0:
            to_start = min(to_start, covered * points[0][1] / inc)
        if to_end >= average * 1.1:
            to_end = average / 2
        rates[start] = inc * (covered + to_start + to_end) / covered / length
    return rates
