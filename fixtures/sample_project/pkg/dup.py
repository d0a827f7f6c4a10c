class Box:
    def doubled(self):
        return 0


def helper():
    return 3
